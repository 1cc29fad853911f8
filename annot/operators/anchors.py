"""Which texts lie in a longer one: texts with the same bytes between anchors, then the SHA-256 of the stretch.

A place in a text is where its next eight bytes begin, and the least hash rules over the places around it, up to a lesser one
on each side or the text's ends. An anchor of level l rules over 2^l places at least. Where a text lies in a longer one, its
anchors are the longer one's too, and those between its first and its last are all that are there. So what is asked for is
the stretch from a text's first to its last anchor, of the lowest level at which it has no more than ANCHORS; longer texts
say where such stretches of theirs are. That is most of a text, so that near copies don't meet: candidates are few. Where a
text repeats itself, a level can have very many anchors and the next one a few close to each other: if they span less than
three quarters of a text, a lower level's stretch is asked for, of up to RUN anchors. Places in long texts are only sent if a
table of bits, of what short texts ask for, knows them.

Texts of less than eight bytes have no place; they are looked for as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annot.sources.shared import written

#: Bytes of a place, anchors of a stretch at most, their lowest level, and anchors at most where more are needed.
PLACE, ANCHORS, LOW, RUN = 8, 32, 4, 4096
#: Bytes of the longest text that is looked for as it is. Such have level 0, of which all places are anchors.
SHORT = 128
#: Bits of the table for each short text, and as a power of two, in all: 64 MB at most.
TEXT_BITS, LEAST_BITS, MOST_BITS = 64, 16, 29
#: Bytes of text that a task looks at at a time; a longer text is looked at alone.
LOOK_BYTES = 1 << 19
#: Anchors that are looked at before the whole stretch: of level 0, and of others.
BEGIN = (16, 4)
_MIX, _NEXT, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_HITS = "key long, large long, at int, room int"
_ASKED = "id long, level int, n int, size int, off int, key long, more long, begin long, one long, digest binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(32)
    x *= _NEXT
    x ^= x >> np.uint64(29)
    return x


def _key(x: np.ndarray, level: int, n: np.ndarray | int) -> np.ndarray:
    """The key of n anchors of a level whose stretch has the hash x."""
    return _mixed(x ^ _mixed(np.atleast_1d(n).astype(np.uint64) + np.uint64((level << 32) + 1)))


def _first(h: np.ndarray, level: int) -> np.ndarray:
    """The key of a stretch's first anchor, of which only the lower bits count."""
    return h ^ np.uint64(level * 0x9E3779B97F4A7)


def _nearest(h: np.ndarray, step: int) -> np.ndarray:
    """For each place the next one in a direction (step -1 or 1) that ends its rule; equal ones do so to the left alone."""
    over = np.greater if step < 0 else np.greater_equal
    at = np.arange(step, len(h) + step)
    open_ = np.flatnonzero(over(h[:-1], h[1:]) if step < 0 else over(h[1:], h[:-1])) + (step < 0)
    open_ = open_[h[open_] > 0]
    while open_.size:
        at[open_] = new = at[at[open_]]
        open_ = open_[over(h[new], h[open_])]
    return at


class _Texts:
    """Some texts one after the other, and what is known of their bytes. A hash of 0 marks bytes that begin no place."""

    _powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        """ends: of each text in data, none of which is empty."""
        self.data, self.size = data, np.diff(ends, prepend=0)
        self.start, self.end = ends - self.size, ends
        self.text = np.repeat(np.arange(len(ends), dtype=np.int32), self.size)
        padded = np.concatenate([data, np.zeros(PLACE, np.uint8)])
        self.value = np.array(np.ndarray(len(data), "<u8", padded, strides=(1,)), np.uint64)
        self.h = np.maximum(_mixed(self.value), np.uint64(1))
        for i in range(1, PLACE):
            self.h[ends[self.size >= i] - i] = 0

    @classmethod
    def _power(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._powers[0]) < n:
            cls._powers = tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, b, np.uint64))]) for b in (_BASE, _BACK))
        return cls._powers

    def measure(self) -> None:
        """The sums from which a stretch's hash comes, the anchors, and how many places each of them rules over.

        What is least in some 2^LOW places is left before rules are measured. What ends an anchor's rule is one itself, so
        that no other place is needed; ends of texts stay too, as nothing rules beyond them.
        """
        n, side = len(self.h), np.zeros((1 << LOW) - 1, np.uint64)
        up, self.back = self._power(n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.h * up[:n], dtype=np.uint64)])
        least = np.concatenate([self.h, side])
        for i in range(LOW):
            least = np.minimum(least[: -1 << i], least[1 << i :])
        most = np.concatenate([side, least])
        for i in range(LOW):
            most = np.maximum(most[: -1 << i], most[1 << i :])
        at = np.concatenate([[-1], np.flatnonzero(most == self.h)])
        h = np.concatenate([np.zeros(1, np.uint64), self.h[at[1:]]])
        rule = at[np.minimum(_nearest(h, 1), len(at) - 1)] - at[_nearest(h, -1)] - 1
        own = np.flatnonzero((h > 0) & (rule >= 1 << LOW))  # of equal ones not all rule
        self.at, self.rule = at[own], rule[own]

    def stretch(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the places from a to b."""
        return (self.sums[b + 1] - self.sums[a]) * self.back[a]

    def tiny(self, n: int) -> np.ndarray:
        """The distinct n bytes, below PLACE, that begin anywhere in longer texts, with n in the highest byte."""
        at = np.flatnonzero(self.size[self.text] > n)
        at = at[at + n <= self.end[self.text[at]]]
        return np.unique(_as_tiny(self.value[at], n))


def _as_tiny(value: np.ndarray, n: int) -> np.ndarray:
    return (value & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 8 * (PLACE - 1))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, _Texts]]:
    """Ids and texts of LOOK_BYTES or a little more at a time; rows have id and seq, which isn't empty."""
    for b in batches:
        ids, seq = b["id"].to_numpy(), b["seq"].cast(pa.large_binary())
        if not len(seq):
            continue
        _, offsets, data = seq.buffers()
        offsets = np.frombuffer(offsets, np.int64)[seq.offset : seq.offset + len(seq) + 1]
        data, a = np.frombuffer(data, np.uint8), 0
        while a < len(seq):
            z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + LOOK_BYTES, "right")) - 1)
            yield ids[a:z], _Texts(data[offsets[a] : offsets[z]], offsets[a + 1 : z + 1] - offsets[a])
            a = z


def _batch(names: list[str], columns: list[np.ndarray | pa.Array]) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: what it asks for, and where that is in it. level is -1 for texts without a place."""
    names = [c.split()[0] for c in _ASKED.split(", ")]
    for ids, x in _groups(batches):
        x.measure()
        many, places = len(ids), x.size - PLACE + 1
        level, n, off = np.full(many, -1, np.int32), x.size.astype(np.int32), np.zeros(many, np.int32)
        key, begin, one = (np.zeros(many, np.uint64) for _ in range(3))
        small = np.flatnonzero(places < 1)
        for size in np.unique(x.size[small]).tolist():
            own = small[x.size[small] == size]
            key[own] = _as_tiny(x.value[x.start[own]], size)
        begin[small] = one[small] = _mixed(key[small])

        def ask(own: np.ndarray, lev: int, a: np.ndarray, b: np.ndarray, z: np.ndarray, most: np.ndarray) -> None:
            """Texts that ask for the anchors from a to z, `most` of them, of which those to b are looked at before."""
            level[own], n[own], off[own] = lev, most, a - x.start[own]
            key[own], one[own] = _key(x.stretch(a, z), lev, most), _first(x.h[a], lev)
            begin[own] = _key(x.stretch(a, b), lev, np.minimum(most, BEGIN[lev > 0]))

        left, at, rule, lev = x.size > SHORT, x.at, x.rule, LOW
        own = np.flatnonzero((places >= 1) & ~left)
        ask(own, 0, x.start[own], x.start[own] + np.minimum(places[own], BEGIN[0]) - 1, x.end[own] - PLACE, places[own])
        while left.any():
            count = np.bincount(x.text[at], minlength=many)
            own = np.flatnonzero(left)
            first, most = (np.cumsum(count) - count)[own], np.minimum(count[own], RUN)
            a, b, z = at[first], at[first + np.minimum(most, BEGIN[1]) - 1], at[first + most - 1]
            wide = (4 * (z - a) >= 3 * places[own]) | (level[own] < 0)  # else what a lower level has is asked for
            ask(own[wide], lev, a[wide], b[wide], z[wide], most[wide])
            left[own] = (count[own] > ANCHORS) & (places[own] >= 2 << lev)
            lev += 1
            stays = np.flatnonzero((rule >= 1 << lev) & left[x.text[at]])
            at, rule = at[stays], rule[stays]
        digest = pa.array([hashlib.sha256(x.data[a:z]).digest() for a, z in zip(x.start, x.end, strict=True)], pa.binary())
        yield _batch(names, [ids, level, n, x.size.astype(np.int32), off, key, _mixed(key), begin, one, digest])


def _look(known: Broadcast, asked: dict[int, np.ndarray], tiny: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Stretches that a short text may ask for: key, the long text's id, its size and where. Without an id: distinct tiny texts."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, names = np.frombuffer(known.value, np.uint8), [c.split()[0] for c in _HITS.split(", ")]
        for ids, x in _groups(batches):
            for n in tiny:
                key = x.tiny(n)
                key = key[_has(bits, _mixed(key))]
                yield _batch(names, [key, pa.nulls(len(key), pa.int64()), np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)])
            if not asked:
                continue
            x.measure()
            found = []
            for level, counts in asked.items():
                at, few = x.at[x.rule >= 1 << level] if level else np.arange(len(x.h)), BEGIN[level > 0]
                first = np.flatnonzero(_has(bits, _first(x.h[at] if level else x.h, level)))
                begun = first[_within(x, at, first, few)]
                begun = begun[_has(bits, _key(x.stretch(at[begun], at[begun + few - 1]), level, few))]
                for some, n in ((first, counts[counts < few]), (begun, counts[counts >= few])):
                    for i in range(0, len(n), step := 1 + LOOK_BYTES // (len(some) + 1)):
                        a, many = np.repeat(some, len(n[i : i + step])), np.tile(n[i : i + step], len(some))
                        there = _within(x, at, a, many)
                        a, many = a[there], many[there]
                        key = _key(x.stretch(at[a], at[a + many - 1]), level, many)
                        good = np.flatnonzero(_has(bits, key))
                        good = good[_has(bits, _mixed(key[good]))]
                        if good.size:
                            found.append((key[good], at[a[good]]))
            if found:
                key, here = map(np.concatenate, zip(*found, strict=True))
                text = x.text[here]
                yield _batch(names, [key, ids[text], (here - x.start[text]).astype(np.int32), x.size[text].astype(np.int32)])

    return look


def _within(x: _Texts, at: np.ndarray, first: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Which of the first anchors have n - 1 more after them in their text."""
    last = at[np.minimum(first + n, len(at)) - 1]
    return np.flatnonzero((first + n <= len(at)) & (x.text[last] == x.text[at[first]]) & (x.h[last] > 0))


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a table has both bits of keys."""
    def set_(keys: np.ndarray) -> np.ndarray:
        slots = (keys & np.uint64(len(bits) * 8 - 1)).view(np.int64)
        return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1

    out = set_(keys)
    likely = np.flatnonzero(out)
    out[likely] = set_(keys[likely] >> np.uint64(24))
    return out


def _table(asked: DataFrame, bits: int) -> bytes:
    """A table of 2^bits bits, set in tasks: two for each key that is looked at on the way to a stretch, four for the stretch."""
    keys = asked.select(F.explode(F.array("one", "begin", "key", "more")).alias("key"))
    slots = keys.select(F.explode(F.array(*[F.shiftrightunsigned("key", s).bitwiseAND((1 << bits) - 1) for s in (0, 24)])).alias("slot"))
    set_ = slots.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, own in set_.collect():
        out[(bucket - 1) << 12 : bucket << 12] = np.frombuffer(own, np.uint8)
    return out.tobytes()


def contained(texts: DataFrame) -> DataFrame:
    """id of each text that lies in a longer one. texts has id, a long, and seq; both are distinct, and no seq is empty.

    Only keys, places and hashes move. A stretch of a long text that is as long as a short text around it is hashed where
    the long text is, once for each size and place, however many short texts ask for it.
    """
    texts = texts.select("id", F.col("seq").cast("binary").alias("seq"))
    asked = written(texts.mapInArrow(_ask, _ASKED), "asked")
    kinds = [tuple(r) for r in asked.groupBy("level", "n").count().collect()]  # at most RUN for each of 31 levels
    counts = {level: np.array([n for at, n, _ in kinds if at == level]) for level in {k[0] for k in kinds} if level >= 0}
    bits = min(max((TEXT_BITS * sum(k[2] for k in kinds)).bit_length(), LEAST_BITS), MOST_BITS)
    known = texts.sparkSession.sparkContext.broadcast(_table(asked, bits))
    hits = written(texts.mapInArrow(_look(known, counts, sorted(n for at, n, _ in kinds if at < 0)), _HITS), "hits")
    tiny = asked.where("level < 0").join(hits.where("large is null").select("key"), "key", "left_semi").select("id")
    start = F.col("at") - F.col("off")
    fits = (start >= 0) & (start + F.col("size") <= F.col("room")) & (F.col("size") < F.col("room"))
    asked = asked.where("level >= 0")
    found = hits.where("large is not null").join(asked.select("key", "off", "size").distinct(), "key").where(fits)
    found = written(found.select("large", "size", start.alias("start")).distinct(), "found")
    here = texts.join(found, texts["id"] == found["large"])
    here = here.select("size", F.unhex(F.sha2(F.substring("seq", F.col("start") + 1, F.col("size")), 256)).alias("digest"))
    return asked.join(here, ["size", "digest"], "left_semi").select("id").unionByName(tiny)
