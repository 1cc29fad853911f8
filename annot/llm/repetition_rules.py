"""Quality rules on repetition within a text, from its suffix array.

The words of many texts are sorted as suffixes at once, by prefix doubling: in each round only suffixes that share their first
2^k words with another of the same text are sorted again. The ranks of all rounds give the longest common prefixes of
neighbours. An interval of suffixes whose common prefix is longer than that with the suffixes around it is a repeated
substring that can't be extended to the right; if the words before them differ it can't be extended to the left either, and
it is a maximal repeat. Every repeated substring lies in a maximal one, so the union of the spans of those of some length
is what the longest repeat at each place covers. The rules limit the share of a text that is covered and the length of the
longest repeat; windows of eight words that occur twice are read off the same array.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .words import coded, groups, split_words

#: Repeats count from so many words on; windows of so many words count as repeated words of the base rules.
LEAST_REPEAT, WINDOW = 5, 8
#: The verdict: at most this share of the words covered by repeats, and no repeat of more words than that.
MOST_COVERED, LONGEST = 0.30, 100
#: The base rules: so many words at least, and repeated words of at most so many percent.
LEAST_WORDS, MOST_REPEATED_PCT = 20, 30
_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_SPACES = b" \t\n\x0b\x0c\r"
_CONTINUES = bytes(range(0x80, 0xC0))


def suffix_array(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all texts, each text's sorted and together, and the words that each shares with the one before it.

    A suffix ends with its text; the shorter of two of which one begins with the other comes first.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    end = starts[1:][text]
    rank, step = text * (int(codes.max()) + 1) + codes, 1
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank[order], np.arange(n), order, np.zeros(n, np.int64))
    rounds = [rank.astype(np.int32)]
    size = np.bincount(rank, minlength=n)
    open_ = order[size[rank[order]] > 1]
    while len(open_):
        then = open_ + step
        ahead = np.where(then < end[open_], rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + ahead
        turn = np.argsort(key, kind="stable")
        sorted_ = open_[turn]
        first = np.flatnonzero(np.concatenate([[True], rank[sorted_[1:]] != rank[sorted_[:-1]]]))
        base = np.repeat(rank[sorted_[first]] - first, np.diff(np.concatenate([first, [len(sorted_)]]))) + np.arange(len(sorted_))
        rank = _ranks(key[turn], base, sorted_, rank.copy())
        rounds.append(rank.astype(np.int32))
        size = np.bincount(rank[sorted_], minlength=n)
        open_ = sorted_[size[rank[sorted_]] > 1]
        step *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    shared = np.zeros(n, np.int64)
    at = np.flatnonzero(rounds[0][order[1:]] == rounds[0][order[:-1]]) + 1
    a, b = order[at - 1], order[at]
    common = np.zeros(len(at), np.int64)
    for k in range(len(rounds) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        inside = inside[(text[a[inside]] == text[order[at[inside]]]) & (text[b[inside]] == text[order[at[inside]]])]
        equal = inside[rounds[k][a[inside]] == rounds[k][b[inside]]]
        common[equal] += 1 << k
        a[equal] += 1 << k
        b[equal] += 1 << k
    shared[at] = common
    return order, shared


def _ranks(keys: np.ndarray, base: np.ndarray, items: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """rank with that of items, sorted by keys, set: base's value at the first item with the same key."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    rank[items] = np.repeat(base[first], np.diff(np.concatenate([first, [len(keys)]])))
    return rank


def maximal_repeats(codes: np.ndarray, starts: np.ndarray, order: np.ndarray, shared: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(words, first and last suffix) of each interval with a common prefix of at least `least` words that different words, or
    the start of the text, precede: the maximal repeats, the inner ones of an interval before it."""
    before = np.where(np.isin(np.arange(len(codes)), starts[:-1]), -1 - np.arange(len(codes)), np.roll(codes, 1))[order] if len(codes) else codes
    out: list[tuple[int, int, int]] = []
    stack: list[list] = []  # words, first suffix, the word before all of them (None: they differ)
    places = np.flatnonzero(shared >= least)
    for i, (r, h) in enumerate(zip(places.tolist(), shared[places].tolist(), strict=True)):
        first, left, own = r - 1, int(before[r - 1]), int(before[r])
        while stack and stack[-1][0] > h:
            words, first, left = stack.pop()
            if left is None:
                out.append((words, first, r - 1))
            if stack and stack[-1][0] >= h:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == left else None
        if not stack or stack[-1][0] < h:
            stack.append([h, first, left])
        stack[-1][2] = stack[-1][2] if stack[-1][2] == own else None
        if i + 1 == len(places) or places[i + 1] != r + 1:
            while stack:
                words, first, left = stack.pop()
                if left is None:
                    out.append((words, first, r))
                if stack:
                    stack[-1][2] = stack[-1][2] if stack[-1][2] == left else None
    return out


def _covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans of these lengths cover."""
    edge = np.bincount(at, minlength=n + 1) - np.bincount(at + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _of_group(raws: list[bytes], least: int, window: int) -> dict[str, np.ndarray]:
    texts = [split_words(raw) for raw in raws]
    codes, starts = coded(texts)
    n, docs = len(codes), len(texts)
    order, shared = suffix_array(codes, starts)
    best = np.zeros(n, np.int64)
    if n:
        best[order] = np.maximum(shared, np.concatenate([shared[1:], [0]]))
    text = np.repeat(np.arange(docs), np.diff(starts))
    out = {"n_words": np.diff(starts)}
    for name, span, wide in (("n_covered", least, None), ("n_repeat_words", window, window)):
        at = np.flatnonzero(best >= span)
        cover = _covered(at, best[at] if wide is None else np.full(len(at), wide), n)
        out[name] = np.bincount(text[cover], minlength=docs)
    out["longest_repeat"] = np.zeros(docs, np.int64)
    np.maximum.at(out["longest_repeat"], text, best)
    repeats = maximal_repeats(codes, starts, order, shared, least)
    out["n_repeats"] = np.bincount(text[order[[r[1] for r in repeats]]], minlength=docs) if repeats else np.zeros(docs, np.int64)
    lines = [[x for x in raw.split(b"\n") if x and not x.isspace()] for raw in raws]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    out["n_symbols"] = np.array([len(raw.translate(None, _NOT_SYMBOLS)) for raw in raws], np.int64)
    out["word_chars"] = np.array([len(raw.translate(None, _SPACES + _CONTINUES)) for raw in raws], np.int64)
    return out


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "n_repeats")


def repetition(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_REPEAT, window: int = WINDOW) -> DataFrame:
    """doc_id and counts, for each row of df: n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word that equal an earlier one), n_repeat_words (words in windows of `window` words that occur twice), n_covered (words in
    maximal repeats of `least` words or more), longest_repeat (words), n_repeats (maximal repeats of such length).

    A text is worked on whole in one task, in memory in proportion to it. Null and empty texts count as without words;
    repeated rows each have their row; other columns of df aren't read; an empty table gives none.
    """
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raws in groups(batches, "_text"):
            found = _of_group(raws, least, window)
            yield pa.RecordBatch.from_arrays([rows["_id"], *(pa.array(found[c], pa.int64()) for c in _COLUMNS)], names=["_id", *_COLUMNS])

    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kinds = ", ".join(f"{c} long" for c in _COLUMNS)
    return rows.mapInArrow(look, f"_id {rows.schema['_id'].dataType.simpleString()}, {kinds}").withColumnRenamed("_id", doc_id)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PCT * F.col("n_words"))


def too_repetitive(covered: float = MOST_COVERED, longest: int = LONGEST) -> Column:
    """More of the words covered by maximal repeats, or a longer repeat, than the rules let pass."""
    return (F.col("n_covered") > covered * F.col("n_words")) | (F.col("longest_repeat") > longest)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document, what the suffix array shows, and the verdict."""
    found = repetition(documents(spark, sf_dir)).withColumn("base_failed", base_failed())
    kept = ~F.col("base_failed") & ~too_repetitive()
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_covered", "longest_repeat", "n_repeats")
