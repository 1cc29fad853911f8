import hashlib
import random
from collections import Counter

import numpy as np

from annot.llm.weighted_sampling import fingerprint_with_edits

from .cases import crowded, odd_rows, table, words


def weights(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    a, b = weights(a), weights(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def edits(rows):
    """rows by descending id, each with its edited and the next text."""
    rows = sorted(rows, key=lambda r: -r[0])
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        yield i, t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt


def test_collision_rate_is_the_weighted_similarity(spark):
    rng = random.Random(8)
    few = [f"v{i}" for i in range(4)]
    rows = [(i, words(rng, rng.randint(20, 120), few if i % 3 == 0 else None)) for i in range(300)]
    got = {r.doc_id: r for r in fingerprint_with_edits(crowded(table(spark, rows))).collect()}
    true, told = [], []
    for i, text, edited, nxt in edits(rows):
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        true += [similarity(text, edited), similarity(text, nxt)]
        told += [got[i].near_edited, got[i].near_next]
    true, told = np.array(true), np.array(told)
    assert abs((told - true).mean()) < 0.02
    assert np.sqrt(((told - true) ** 2).mean()) < 1.25 * np.sqrt((true * (1 - true) / 32).mean()) + 0.005


def test_equal_texts_and_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    rows = list(dict(rows).items()) + [(50, "same words here and more of them"), (51, "same words here and more of them")]
    got = {r.doc_id: r for r in fingerprint_with_edits(crowded(table(spark, rows))).collect()}
    assert got[50].fingerprint == got[51].fingerprint and got[51].near_next == 1
    assert got[1].fingerprint == got[2].fingerprint and got[1].n_chars == 0
    for i, _, edited, _ in edits(rows):
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def test_repeated_rows_null_ids_and_small_tables(spark):
    rows = odd_rows()
    assert fingerprint_with_edits(table(spark, rows)).count() == len(rows)
    assert fingerprint_with_edits(table(spark, [])).count() == 0
    one = fingerprint_with_edits(table(spark, [(1, "abcdef")])).collect()
    assert len(one) == 1 and one[0].near_next == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprint_with_edits(table(spark, [(None, "abcdef"), (None, "b")])).count() == 2


def test_a_fingerprint_has_32_places(spark):
    rows = [(i, words(random.Random(i), 60)) for i in range(20)]
    for r in fingerprint_with_edits(table(spark, rows)).collect():
        assert len(r.fingerprint) == len(r.edited_fingerprint) == 32 * 8
        assert (r.near_edited * 32).is_integer() and (r.near_next * 32).is_integer()
