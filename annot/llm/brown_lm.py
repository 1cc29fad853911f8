"""Language-model scores by class-based bigrams, the classes found by exchange clustering.

P(word | previous word) = P(class | previous class) * P(word | class), mixed with the unigram model. Every word that the
training texts hold has a class of its own finding:

1. The CORE most frequent words are clustered by exchange: one word at a time moves to the class that raises the bigram
   likelihood most, until nothing moves. All other words together stand for one more neighbour.
2. Of every other word, all occurrences are counted by the classes of the words before and after them. The word goes to
   the class for which the exchange criterion grows most; as its counts are small beside a class's, that growth is a sum
   over its neighbours of log(n(c, d) N / (n(c) n(d))), so that a task gives a class to as many words as it has.
   That is done ROUNDS times: from the second on, neighbours that aren't of the core have classes as well.
3. Transitions between the classes of all words are counted over the training texts, and give every text's score.

Words that no training text holds are one event, as in the base score. A class gives it the share that words met once have
of its tokens (Good and Turing's estimate); as an unknown word's class isn't known, it is a mixture of all classes, both
when it comes and in what comes after it. The weights of the mixture with the unigram model and of the smoothing are those
that make the training transitions likeliest, each left out of the counts in turn.

With c(w) + 1 in the numerators of both models, a text's score is a sum of log10(c(w) + 1), which the base score has too,
and of a term of classes alone. Texts are split into words twice: to count words, and to write them as numbers. A word is
known by 63 bits of a hash; that no two words share them is checked by 64 more bits, and another seed is taken otherwise.
Frequent words (a bounded table) have small numbers that all tasks know; all others are joined by hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fold_of, written
from .words import groups

#: Words whose numbers, counts and classes are sent to every task, at most; the core is always among them.
NEAR_WORDS = 200_000
#: Words that are clustered by exchange; the others are placed by their neighbours' classes.
CORE = 1000
#: Words after the core whose neighbours a task adds up before it hands them on: no word beyond has a large share of a text.
MIDDLE = 16_384
CLASSES = 64
#: Times that words beyond the core are placed.
ROUNDS = 2
#: Weights of the class model beside the unigram model, and of the unigram class distribution in each class's transitions,
#: in counts. The likeliest pair is taken.
MIXES, SMOOTHS = (0.8, 0.9, 0.95, 0.98, 0.99, 0.995), (1.0, 5.0, 20.0, 50.0, 100.0, 200.0, 500.0)
#: Distinct words that a task counts before it hands them on, and words whose numbers it remembers.
FLUSH, MEMO = 300_000, 200_000
END = b""  # no word is empty


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8, A-Z lower-cased; bytes.split() cuts at just the white space that the contract names."""
    return (text or "").encode("utf-8", "replace").lower().split()


def keys_of(words: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A negative number for each word, from 63 bits of its hash, and the 64 other bits."""
    import xxhash

    both = np.frombuffer(b"".join(map(partial(xxhash.xxh3_128_digest, seed=seed), words)), ">u8").reshape(-1, 2)
    return -1 - (both[:, 1] >> np.uint64(1)).astype(np.int64), both[:, 0].astype("<u8").view(np.int64)


def _count_words(seed: int):
    """key and check of each word, and c, how often training texts hold it; an end for each of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, other = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = [*seen, *(w for w in other if w not in seen)]
            key, check = keys_of(words, seed)
            c = np.zeros(len(words), np.int64)
            c[: len(seen)] = list(seen.values())
            seen.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(check), pa.array(c)], names=["key", "check", "c"])

        for part, texts in groups(batches, "text"):
            for raw, learn in zip(texts, part["learn"].to_pylist(), strict=True):
                (seen if learn else other).update(raw.lower().split())
                seen[END] += learn
                if len(seen) + len(other) > FLUSH:
                    yield out()
        yield out()

    return run


class _Places:
    """The number of each word: 0 the end, from 1 on words by frequency, of words that aren't near their negative key."""

    def __init__(self, keys: np.ndarray, seed: int):
        self.known: dict[bytes, int] = {END: 0}
        self.near, self.seed = {k: i + 1 for i, k in enumerate(keys.tolist())}, seed

    def of(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > MEMO:
            self.known = {END: 0}
            new = set(words) - {END}
        if new:
            keys = keys_of(list(new), self.seed)[0].tolist()
            self.known.update(zip(new, map(self.near.get, keys, keys), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


def _lists(values: np.ndarray, lengths: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values, pa.int64()))


def _encode(shared, seed: int):
    """codes, four bytes a token, and far, the keys of a text's words that aren't near: their codes go on after the near ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        places, size = _Places(keys, seed), len(keys)
        for part, texts in groups(batches, "text"):
            words, stops = [], []
            for raw in texts:
                words += raw.lower().split()
                words.append(END)
                stops.append(len(words))
            numbers, codes, far = places.of(words), [], []
            for at in np.split(numbers, stops[:-1]):
                away = at < 0
                own, at[away] = np.unique(at[away], return_inverse=True)
                at[away] += size + 1
                codes.append(at.astype("<u4").tobytes())
                far.append(own)
            columns = [part["doc_id"], part["learn"], part["wanted"], pa.array(codes, pa.binary()), _lists(np.concatenate(far), [len(x) for x in far])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "learn", "wanted", "codes", "far"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with some megabytes of codes, the codes of all, and the number of tokens of each."""
    for part, raw in groups(batches, "codes"):
        yield part, np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.array([len(r) // 4 for r in raw], np.int64)


def _before(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code before each token; an end, 0, before the first one of each text."""
    out = np.zeros_like(codes)
    out[1:] = codes[:-1]
    out[np.cumsum(lengths)[:-1]] = 0
    return out


def _count_pairs(numbers: np.ndarray, width: int):
    """pair, n: how often a number comes before another one; numbers: that of each code, the last one for all codes beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(width * width, np.int64)
        for _, codes, lengths in _tokens(batches):
            own = numbers[np.minimum(codes, len(numbers) - 1)]
            key = _before(own, lengths) * width + own
            if 4 * len(key) > len(pairs):
                pairs += np.bincount(key, minlength=len(pairs))
            else:
                np.add.at(pairs, key, 1)
        key = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(pairs[key])], names=["pair", "n"])

    return run


def _pair_table(docs: DataFrame, numbers: np.ndarray, width: int) -> np.ndarray:
    found = docs.select("codes").mapInArrow(_count_pairs(numbers, width), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # width ** 2 rows at most
    table = np.zeros(width * width)
    table[found["pair"].to_numpy()] = found["n"].to_numpy()
    return table.reshape(width, width)


def _neighbours(shared, cls: np.ndarray, core: int, width: int, middle: int):
    """key and around, what is before and after a word that isn't of the core: two bytes an occurrence, the classes, or where
    `dense` says so four bytes for each class before and each class after, the number of times. cls: as in _count_pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        size, dense = len(keys), min(middle, max(len(keys) - core, 0))
        sums = np.zeros(dense * 2 * width, np.int64)
        for part, codes, lengths in _tokens(batches):
            c = cls[np.minimum(codes, len(cls) - 1)]
            before = _before(c, lengths)
            at = np.flatnonzero((codes > core) & (codes <= core + dense))
            row = (codes[at] - core - 1) * 2 * width
            if len(at):
                sums += np.bincount(row + before[at], minlength=len(sums)) + np.bincount(row + width + c[at + 1], minlength=len(sums))
            at = np.flatnonzero(codes > core + dense)  # never a text's end, so each has a token after it
            if not len(at):
                continue
            number, away = codes[at], codes[at] > size
            key = np.empty(len(at), np.int64)
            key[~away] = keys[number[~away] - 1]
            per_text = pc.list_value_length(part["far"]).to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(np.cumsum(per_text) - per_text, lengths)[at]
            key[away] = pc.list_flatten(part["far"]).to_numpy()[base[away] + number[away] - size - 1]
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            raw = np.stack([before[at], c[at + 1]], 1).astype(np.uint8).tobytes()
            cuts = np.append(2 * first, len(raw)).astype(np.int32)
            around = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.zeros(len(first), bool)), around], names=["key", "dense", "around"])
        sums = sums.reshape(dense, 2 * width)
        rows = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[core + rows], pa.int64()), pa.array(np.ones(len(rows), bool)), pa.array([r.tobytes() for r in sums[rows].astype("<i4")], pa.binary())],
            names=["key", "dense", "around"],
        )

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange_clusters(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 12, rest: bool = False) -> np.ndarray:
    """Class of each unit, from the matrix of neighbour counts; unit 0, the end, keeps class 0 to itself.

    Starts with the units dealt by frequency; each round takes every unit once, most frequent first. With rest, the last
    unit stands for all words that aren't units, and keeps a class of its own, numbered `classes`.
    """
    n = len(pairs)
    pairs = pairs.astype(float)
    freq = pairs.sum(0) + pairs.sum(1)
    order = [int(u) for u in np.argsort(-freq, kind="stable") if u and freq[u] > 0 and not (rest and u == n - 1)]
    cls = np.zeros(n, np.int64)
    for i, u in enumerate(order):
        cls[u] = 1 + i % (classes - 1)
    cls[(freq == 0) & (np.arange(n) > 0)] = classes - 1
    width = classes + rest
    if rest:
        cls[n - 1] = classes
    member = np.zeros((n, width))
    member[np.arange(n), cls] = 1
    table = member.T @ pairs @ member
    out_of, into = pairs @ member, pairs.T @ member  # unit to class, class to unit
    diagonal = np.arange(width)
    for _ in range(rounds):
        moved = 0
        for u in order:
            a, own = cls[u], pairs[u, u]
            right, left = out_of[u].copy(), into[u].copy()
            right[a] -= own
            left[a] -= own
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= own
            rows, cols = table.sum(1), table.sum(0)
            r, l = right.sum() + own, left.sum() + own
            # Likelihood: sum of f(n(c, d)) less f of both margins, for the unit in each class.
            gain = (_xlogx(table + right) - _xlogx(table)).sum(1) + (_xlogx(table.T + left) - _xlogx(table.T)).sum(1)
            d = table[diagonal, diagonal]
            gain += _xlogx(d + right + left + own) + _xlogx(d) - _xlogx(d + right) - _xlogx(d + left)
            gain -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + l) - _xlogx(cols)
            gain[0] = -np.inf
            gain[classes:] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += own
            if b != a:
                moved += 1
                cls[u] = b
                out_of[:, a] -= pairs[:, u]
                out_of[:, b] += pairs[:, u]
                into[:, a] -= pairs[u]
                into[:, b] += pairs[u]
        if not moved:
            break
    return cls


def association(table: np.ndarray) -> np.ndarray:
    """log(n(c, d) N / (n(c) n(d))) for each class c and the class d after it, counts smoothed towards independence."""
    total = table.sum() + 1
    rows, cols = table.sum(1, keepdims=True) + 1, table.sum(0, keepdims=True) + 1
    chance = rows * cols / total
    return np.log((table + 0.5 * np.minimum(chance, 1) + 1e-9) / (chance + 0.5 * np.minimum(chance, 1) + 1e-9))


def _place_words(growth: np.ndarray, classes: int):
    """key, cls and c of each word, from rows sorted by key. growth[a, d]: for a class d after a class a, and the other way."""
    width = len(growth)
    weights = np.concatenate([growth, growth.T])[:, 1:classes]

    def solve(keys, counts: np.ndarray) -> pa.RecordBatch:
        best = np.round(counts @ weights, 9).argmax(1) + 1
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(best.astype(np.int16)), pa.array(counts[:, :width].sum(1))], names=["key", "cls", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key and counts of the last word, which may go on
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                key, dense, around = part["key"].to_numpy(), part["dense"].to_numpy(zero_copy_only=False), part["around"].to_pylist()
                new = np.concatenate([[True], key[1:] != key[:-1]])
                keys, group = key[new], np.cumsum(new) - 1
                counts = np.zeros((len(keys), 2 * width), np.int64)
                if dense.any():
                    np.add.at(counts, group[dense], np.frombuffer(b"".join(x for x, d in zip(around, dense, strict=True) if d), "<i4").reshape(-1, 2 * width))
                short = [b"" if d else x for x, d in zip(around, dense, strict=True)]
                raw = np.frombuffer(b"".join(short), np.uint8).reshape(-1, 2)
                own = np.repeat(group, [len(x) // 2 for x in short]) * 2 * width
                flat = counts.reshape(-1)
                np.add.at(flat, own + raw[:, 0], 1)
                np.add.at(flat, own + width + raw[:, 1], 1)
                if held is not None and held[0] == keys[0]:
                    counts[0] += held[1]
                elif held is not None:
                    yield solve([held[0]], held[1][None])
                yield solve(keys[:-1], counts[:-1])
                held = keys[-1], counts[-1]
        if held is not None:
            yield solve([held[0]], held[1][None])

    return run


def _fill(shared, unknown: int, width: int):
    """Transitions of each text as two bytes a token, n_tokens, n_known and the sum of log10(c + 1); far_*: what is known of far words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, cls = shared.value
        logs, size = np.log10(c + 1.0), len(c)
        for batch in batches:
            rows = []
            for raw, n, i, far_c, far_cls in zip(*(batch[x] for x in ("codes", "n_far", "far_i", "far_c", "far_cls")), strict=True):
                codes = np.frombuffer(raw, "<u4").astype(np.int64)
                own_cls, own_c, own_log = cls, c, logs
                if n:
                    more_cls, more_c = np.full(n, unknown), np.zeros(n)
                    if i is not None:
                        more_cls[i], more_c[i] = far_cls, far_c
                    away = codes >= size
                    k, at = np.where(away, codes - size, 0), np.where(away, 0, codes)
                    own, known, log = np.where(away, more_cls[k], cls[at]), np.where(away, more_c[k], c[at]) > 0, np.where(away, np.log10(more_c + 1)[k], logs[at])
                else:
                    own, known, log = own_cls[codes], own_c[codes] > 0, own_log[codes]
                before = np.concatenate([[0], own[:-1]])
                rows.append(((before * width + own).astype("<u2").tobytes(), len(codes), int(known.sum()), float(log.sum())))
            out = pd.DataFrame(rows, columns=["cells", "n_tokens", "n_known", "logs"])
            yield batch[["doc_id", "learn", "wanted"]].reset_index(drop=True).assign(**out)

    return run


def _count_cells(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for _, raw in groups(batches, "cells"):
            total += np.bincount(np.frombuffer(b"".join(raw), "<u2"), minlength=cells)
        key = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(total[key])], names=["cell", "n"])

    return run


def _parts(table: np.ndarray, kinds: np.ndarray, once: np.ndarray, n: int, v: int, smooth: float, left_out: int = 0):
    """Class transitions, P(word | class) / (c + 1) of known words, the share of unknown ones by class, and both of the unigrams."""
    tokens = table.sum(0)
    start = (tokens + 1) / (tokens.sum() + len(tokens))
    step = (np.maximum(table - left_out, 0) + smooth * start) / (np.maximum(table.sum(1, keepdims=True) - left_out, 0) + smooth)
    unseen = (once + 0.5) / (tokens + 1)
    unseen[0] = 0  # an end is never unknown
    unseen = np.minimum(unseen, 0.99)
    rare = min((once.sum() + 0.5) / (n + 1), 0.99)
    return start, step, (1 - unseen) / np.maximum(tokens + kinds - left_out, 1), unseen, (1 - rare) / max(n + v - left_out, 1), rare


def mixing_weights(table: np.ndarray, kinds: np.ndarray, once: np.ndarray, n: int, v: int) -> tuple[float, float]:
    """The pair of MIXES and SMOOTHS for which the training transitions are likeliest, each left out of the counts in turn."""
    best = {}
    for smooth in SMOOTHS:
        _, step, word, _, plain, _ = _parts(table, kinds, once, n, v, smooth, left_out=1)
        for mix in MIXES:
            best[mix, smooth] = float((table * np.log(mix * step * word + (1 - mix) * plain)).sum())
    return max(best, key=lambda pair: (round(best[pair], 6), pair))


def class_terms(table: np.ndarray, kinds: np.ndarray, once: np.ndarray, n: int, v: int) -> np.ndarray:
    """log10 of what multiplies c(w) + 1, for each previous class and class; the last of both is that of unknown words.

    table: transitions; kinds, once: words of each class, and those met once. All known words and the one unknown event add
    up to 1 after each class.
    """
    mix, smooth = mixing_weights(table, kinds, once, n, v)
    start, step, word, unseen, plain, rare = _parts(table, kinds, once, n, v, smooth)
    by_class = start * unseen
    rows = np.vstack([step, by_class @ step / by_class.sum()])
    known = mix * rows * word + (1 - mix) * plain
    return np.log10(np.hstack([known, mix * (rows @ unseen)[:, None] + (1 - mix) * rare]))


def _sum_terms(terms: np.ndarray):
    flat = terms.reshape(-1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            classes = [float(flat[np.frombuffer(raw, "<u2")].sum()) for raw in batch["cells"]]
            yield batch.drop(columns="cells").reset_index(drop=True).assign(classes=classes)

    return run


def near_words(words: DataFrame, most: int) -> pd.DataFrame:
    """key and c of the most frequent words, whole ranks of like counts only, at most `most`."""
    size = F.floor(F.log2("c") * 16)
    ranks = sorted(words.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"])  # a few hundred rows at any size
    total, least = 0, None
    for r in ranks:
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    return (words.where(size >= least) if least is not None else words.limit(0)).toArrow().to_pandas()


def count_words(texts: DataFrame) -> tuple[DataFrame, int, int, int]:
    """key and c of the words of all texts (text, learn), their tokens and distinct words in training, and the seed of the keys."""
    for seed in range(8):
        each = texts.select("text", "learn").mapInArrow(_count_words(seed), "key long, check long, c long")
        words = written(each.groupBy("key").agg(F.sum("c").alias("c"), (F.min("check") != F.max("check")).alias("clash")), "lm-words")
        n, v, clash = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.bool_or("clash"), F.lit(False))).head()
        if not clash:
            return words.select("key", "c"), n, v, seed
    raise RuntimeError("no seed gives all words keys of their own")


def word_classes(docs: DataFrame, shared, core: int, classes: int, rounds: int, middle: int, least: float) -> tuple[DataFrame, np.ndarray]:
    """key, cls and c of every word beyond the core in docs (codes, far), and the class of each near code.

    shared: the near keys; least: the count that near words beyond the core have at least.
    """
    keys = shared.value
    cls = np.full(len(keys) + 2, classes)
    cls[: core + 1] = np.arange(core + 1)
    pairs = _pair_table(docs, np.append(np.arange(core + 1), core + 1), core + 2)
    units = exchange_clusters(pairs, classes, rest=True)
    cls[: core + 1] = units[: core + 1]
    member = np.zeros((core + 2, classes + 1))
    member[np.arange(core + 2), units] = 1
    table, placed = member.T @ pairs @ member, None
    place = pd.Series(np.arange(1, len(keys) + 1), keys)
    for i in range(max(rounds, 1)):
        if i:
            table = _pair_table(docs, cls, classes + 1)
        rows = docs.select("codes", "far").mapInArrow(_neighbours(shared, cls, core, classes + 1, middle), "key long, dense boolean, around binary")
        placed = written(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_place_words(association(table), classes), "key long, cls short, c long"), "lm-placed")
        near = placed.where(F.col("c") >= least).select("key", "cls").toArrow().to_pandas()  # the near words beyond the core
        cls = cls.copy()
        cls[place[near["key"]].to_numpy()] = near["cls"]
    return placed, cls[:-1]


def score_texts(
    df: DataFrame, train: DataFrame | Column, doc_id: str = "doc_id", text: str = "text", near: int = NEAR_WORDS, classes: int = CLASSES, core: int = CORE, rounds: int = ROUNDS, middle: int = MIDDLE
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for each row of df, with a model of the training texts.

    train: a condition on df's rows, or another table. Null texts count as empty: one end token. Repeated rows count each;
    null ids, extra columns and very long texts are no trouble. Without training texts no word is known. An empty df gives
    an empty table. Of words of equal frequency those with the larger key come first.
    """
    spark = df.sparkSession
    id_type = df.schema[doc_id].dataType.simpleString()
    row = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    if isinstance(train, Column):
        whole = df.select(*row, F.coalesce(train, F.lit(False)).alias("learn"), F.lit(True).alias("wanted"))
    else:
        whole = df.select(*row, F.lit(False).alias("learn"), F.lit(True).alias("wanted")).unionByName(train.select(F.lit(None).cast(id_type).alias("doc_id"), row[1], F.lit(True).alias("learn"), F.lit(False).alias("wanted")))
    counted, n, v, seed = count_words(whole)
    end = int(keys_of([END], seed)[0][0])
    words = counted.where((F.col("c") > 0) & (F.col("key") != end))
    first = words.orderBy(F.col("c").desc(), F.col("key").desc()).limit(core).toArrow().to_pandas()
    more = near_words(words, near)
    known = pd.concat([first, more]).drop_duplicates("key").sort_values(["c", "key"], ascending=False, ignore_index=True)
    core = len(first)
    least = float(known["c"].min()) if len(known) > core else float("inf")
    shared = spark.sparkContext.broadcast(known["key"].to_numpy(np.int64))

    docs = written(whole.mapInArrow(_encode(shared, seed), f"doc_id {id_type}, learn boolean, wanted boolean, codes binary, far array<long>").withColumn("uid", F.monotonically_increasing_id()), "lm-docs")
    placed, cls = word_classes(docs.where("learn"), shared, core, classes, rounds, middle, least)
    kinds, once = np.zeros(classes), np.zeros(classes)
    np.add.at(kinds, cls[: core + 1], 1)
    np.add.at(once, cls[1 : core + 1], known["c"].to_numpy()[:core] == 1)
    kinds[0] = min(n, 1)
    for r in placed.groupBy("cls").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("c") == 1).alias("one")).collect():  # a row a class
        kinds[r["cls"]] += r["k"]
        once[r["cls"]] += r["one"]
    ends = counted.where(F.col("key") == end).head()
    table_of = spark.sparkContext.broadcast((np.concatenate([[ends["c"] if ends else 0], known["c"].to_numpy(float)]), cls))

    asked = docs.where(F.size("far") > 0).select("uid", F.posexplode("far").alias("i", "key"))
    told = asked.join(placed.where(F.col("c") < least), "key").groupBy("uid").agg(F.collect_list(F.struct("i", "c", "cls")).alias("told"))
    filled = docs.withColumn("n_far", F.size("far")).drop("far").join(told, "uid", "left")
    filled = filled.withColumns({f"far_{x}": F.col(f"told.{x}") for x in ("i", "c", "cls")}).drop("told", "uid")
    width = classes + 1
    filled = written(filled.mapInPandas(_fill(table_of, classes, width), f"doc_id {id_type}, learn boolean, wanted boolean, cells binary, n_tokens long, n_known long, logs double"), "lm-cells")
    found = filled.where("learn").select("cells").mapInArrow(_count_cells(width * width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # width ** 2 rows at most
    table = np.zeros(width * width)
    table[found["cell"].to_numpy()] = found["n"].to_numpy()
    terms = class_terms(table.reshape(width, width)[:classes, :classes], kinds, once, n, v)
    out = filled.where("wanted").drop("learn", "wanted").mapInPandas(_sum_terms(terms), f"doc_id {id_type}, n_tokens long, n_known long, logs double, classes double")
    return out.select(
        "doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), (F.col("logs") + F.col("classes")).alias("score"),
    )


def op5_class_lm_scores(spark, sf_dir: str) -> DataFrame:
    held = fold_of(F.col("doc_id"), 7) == 2
    return score_texts(documents(spark, sf_dir), ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
