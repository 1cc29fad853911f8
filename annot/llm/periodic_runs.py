"""Periodic runs in texts: stretches of words that repeat with a smallest period, four times or more.

A text's words are appended one by one to a suffix automaton. Its suffix links form a tree in which the strings that end at
a word are the path from that word's state to the root. A link-cut tree holds the tree in preferred paths, all of whose
states ended last at one place; so the access of a new state meets, segment by segment, the place `j` at which the longest
string of length L of a segment ended before, and recolours the path with the new place `i`. Where i - j <= L the string and
its last occurrence overlap or touch: L + (i - j) words up to i have period i - j, which is a square, and i - j is their
smallest period, as a smaller one would have given a later occurrence. L is the longest common suffix at i and j, so the
stretch reaches as far to the left as it can, and it is a run if the next word breaks the period.

Only stretches that can hold a run are given to the automaton. In a run of period q all triples of words but those of its
first q words occurred q words before; for every power of two the consecutive triples that occurred at less than twice this
distance are found by one sort, and where there are fewer than a run of such a period has, there is none. That leaves out
no run; stretches that meet are read as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .words import coded, groups, split_words

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_RUN = "struct<start:long,length:long,period:long>"
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def automaton_runs(word: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of a sequence: length >= max(least, periods * period), periods >= 3.

    State 0 is none and state 1 the root. left, right and up are the link-cut tree's splay trees, one for each preferred
    path, with a path's parent above its root; seen is, at the root of a splay tree, the last end of its states.
    """
    after: list[dict[int, int]] = [{}, {}]
    link, size, left, right, up, seen = [0, 0], [0, 0], [0, 0], [0, 0], [0, 0], [-1, -1]

    def add(length: int, to: dict[int, int], parent: int) -> int:
        for a, x in ((after, to), (link, parent), (size, length), (left, 0), (right, 0), (up, parent), (seen, -1)):
            a.append(x)
        return len(link) - 1

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            left[p] = b = right[x]
            right[x] = p
        else:
            right[p] = b = left[x]
            left[x] = p
        if b:
            up[b] = p
        up[p], up[x] = x, g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    def splay(x: int) -> None:
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                return
            g = up[p]
            if not g or (left[g] != p and right[g] != p):
                seen[x] = seen[p]
                rotate(x, p)
                return
            h = up[g]
            if not h or (left[h] != g and right[h] != g):
                seen[x] = seen[g]
            rotate(p if (left[g] == p) == (left[p] == x) else x, g if (left[g] == p) == (left[p] == x) else p)
            rotate(x, up[x])

    out, last, n = [], 1, len(word)
    for i, c in enumerate(word):
        new, p = add(i + 1, {}, 1), last
        while p and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p:
            q = after[p][c]
            if size[p] + 1 < size[q]:
                splay(q)
                half = add(size[p] + 1, dict(after[q]), link[q])
                if left[q]:
                    up[left[q]] = half
                left[half], left[q], up[half], link[q] = left[q], half, q, half
                while p and after[p].get(c) == q:
                    after[p][c] = half
                    p = link[p]
                q = half
            link[new] = up[new] = q
        last = below = new
        at = up[new]
        while at:
            splay(at)
            before = seen[at]
            d, common = i - before, size[at]
            if before >= 0 and common >= (periods - 1) * d and common + d >= least and (i + 1 == n or word[i + 1] != word[i + 1 - d]):
                out.append((i + 1 - common - d, common + d, d))
            if right[at]:
                seen[right[at]] = before
            right[at] = below
            below, at = at, up[at]
        seen[below] = i
    return sorted((a, length, d) for a, length, d in out)


def stretches(codes: np.ndarray, starts: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """First and last word (exclusive) of stretches outside which there is no run; none crosses the start of a text."""
    n, m = len(codes), len(codes) - 2
    if m < 1:
        return np.zeros((0, 2), np.int64)
    k = int(codes.max()) + 1
    pairs = codes[:-1] * k + codes[1:]
    if k * k * k >= 1 << 62:
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    triples = pairs[:-1] * k + codes[2:]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(triples, kind="stable")
    same = (triples[order[1:]] == triples[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    back = np.full(m, n, np.int64)
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    back[text[:m] != text[2:]] = n
    found, step = [], 1
    most = int(np.diff(starts).max(initial=0))
    while periods * step <= most:
        need = max(least - step - 2, 1) if step == 1 else max(1, (periods - 1) * step - 2, least - 2 * step - 1)
        edge = np.diff(np.concatenate([[0], (back < 2 * step).astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = b - a >= need
        a, b = a[long], b[long]
        found.append(np.stack([np.maximum(a - (2 * step - 1), starts[text[a]]), b + 2], 1))
        step *= 2
    found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    if not len(found):
        return found
    found = found[np.argsort(found[:, 0], kind="stable")]
    reach = np.maximum.accumulate(found[:, 1])
    first = np.concatenate([[True], (found[1:, 0] >= reach[:-1]) | (text[found[1:, 0]] != text[found[:-1, 0]])])
    ends = np.concatenate([reach[np.flatnonzero(first)[1:] - 1], reach[-1:]])
    return np.stack([found[first, 0], ends], 1)


def _of_group(texts: list[list[bytes]], least: int, periods: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start, then period."""
    codes, starts = coded(texts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in stretches(codes, starts, least, periods).tolist():
        doc = int(np.searchsorted(starts, a, "right")) - 1
        shift = a - int(starts[doc])
        out[doc] += [(shift + s, length, d) for s, length, d in automaton_runs(codes[a:b].tolist(), least, periods)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), best (of greatest length / period; ties:
    least start, then period), collapsed (the words that stay, joined by one space): a row for each row of df.

    order(doc_id, n) may give the places of the words that are read instead of all n in turn. A text is worked on whole in
    one task, in memory in proportion to it. Null and empty texts have no words and no runs; repeated rows each have their
    row; other columns of df aren't read; an empty table gives none.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws in groups(batches, "_text"):
            texts = [split_words(raw) for raw in raws]
            if order is not None:
                for i, key in enumerate(rows["_id"].to_pylist()):
                    places = order(key, len(texts[i]))
                    if places is not None:
                        own = texts[i]
                        texts[i] = [own[k] for k in places.tolist()]
            runs = _of_group(texts, least, periods)
            best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else None for r in runs]
            named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
            yield pa.RecordBatch.from_arrays([
                rows["_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([[named(x) for x in r] for r in runs], pa.list_(_ARROW_RUN)),
                pa.array([named(b) for b in best], _ARROW_RUN), pa.array([b" ".join(collapsed(t, r)) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
            ], names=["_id", "n_words", "runs", "best", "collapsed"])

    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    out = rows.mapInArrow(look, f"_id {rows.schema['_id'].dataType.simpleString()}, n_words long, runs array<{_RUN}>, best {_RUN}, collapsed string")
    return out.withColumnRenamed("_id", doc_id)


def planted_order(doc_id: object, n: int) -> np.ndarray | None:
    """The contract's order of words: of every tenth text, by its id's CRC-32, the end repeats with a period."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; a null id counts as the empty text where its CRC-32 is taken."""
    found = periodic_runs(documents(spark, sf_dir), order=planted_order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
