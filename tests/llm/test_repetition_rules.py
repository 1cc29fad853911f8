import random
from collections import defaultdict

import numpy as np
import pytest

from annot.llm.repetition_rules import op12_quality_rules, repetition, suffix_array

from .cases import crowded, odd_rows, table, words


def plain(text, least, window):
    """All substrings of a text's words: those that occur twice, and are preceded and followed by different words."""
    w = (text or "").encode().split()
    n, where = len(w), defaultdict(list)
    for i in range(n):
        for j in range(i + 1, n + 1):
            where[tuple(w[i:j])].append(i)
    again = {k: v for k, v in where.items() if len(v) > 1}
    maximal = {k: v for k, v in again.items() if len(k) >= least and len({w[i - 1] if i else None for i in v}) > 1 and len({w[i + len(k)] if i + len(k) < n else None for i in v}) > 1}
    covered = {i + x for k, v in maximal.items() for i in v for x in range(len(k))}
    repeated = {i + x for k, v in again.items() if len(k) == window for i in v for x in range(window)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    spaces = set(" \t\n\x0b\x0c\r")
    return {
        "n_words": n, "word_chars": sum(c not in spaces for c in text or ""), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated),
        "n_covered": len(covered), "longest_repeat": max(map(len, again), default=0), "n_repeats": len(maximal),
    }


def texts(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        own = words(rng, rng.randint(0, 45), [str(i) for i in range(rng.choice([1, 2, 4, 9]))])
        out.append(own.replace(" 1 ", "\n", rng.randint(0, 3)))
    return [*out, "# * $ % & | < > é ü 世界", "one two\n one two\none two\n\n\none two", "\x1c \x1d\n\x1c"]


@pytest.mark.parametrize("least,window", [(2, 3), (1, 1), (5, 8)])
def test_counts_equal_brute_force(spark, least, window):
    rows = list(enumerate(texts(least)))
    got = repetition(crowded(table(spark, rows)), least=least, window=window).collect()
    assert {r.doc_id: {k: v for k, v in r.asDict().items() if k != "doc_id"} for r in got} == {i: plain(t, least, window) for i, t in rows}


def test_suffixes_of_each_text_are_sorted():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(0, 30, 4)
        codes, starts = rng.integers(0, 3, sizes.sum()), np.concatenate([[0], np.cumsum(sizes)])
        order, shared = suffix_array(codes, starts)
        at = 0
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = [tuple(codes[i:b]) for i in range(a, b)]
            assert [tuple(codes[i:b]) for i in order[at : at + b - a]] == sorted(own)
            for x in range(at + 1, at + b - a):
                p, q = codes[order[x - 1] : b], codes[order[x] : b]
                m = min(len(p), len(q))
                assert shared[x] == (np.flatnonzero(p[:m] != q[:m]).min(initial=m))
            at += b - a


def test_verdict(spark, tmp_path):
    rng = random.Random(8)
    many = [f"w{i}" for i in range(5000)]
    clean, passage = words(rng, 600, many), words(rng, 101, many)
    rows = [
        (1, clean), (2, "buy this now and get more " * 30), (3, f"{clean} {passage} x {passage} {clean[:50]}"), (4, "too few words"), (5, " ".join(f"{words(rng, 7, many)} a b c d e" for _ in range(40))),
        (6, f"{clean} a short line that is said twice . {words(rng, 20, many)} a short line that is said twice ."), (7, None), (8, "same " * 40_000),
    ]
    crowded(table(spark, rows)).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op12_quality_rules(spark, str(tmp_path)).collect()}
    assert {i: (r.base_failed, r.kept) for i, r in got.items()} == {1: (False, True), 2: (True, False), 3: (False, False), 4: (True, False), 5: (False, False), 6: (False, True), 7: (True, False), 8: (True, False)}
    assert got[8].longest_repeat == 39_999 and got[8].n_repeat_words == 40_000


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows()
    got = repetition(crowded(table(spark, rows))).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in got) == sorted((str(i), len((t or "").encode().split())) for i, t in rows)
    assert repetition(table(spark, []).where("false")).collect() == []
