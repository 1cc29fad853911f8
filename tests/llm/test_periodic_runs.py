import hashlib
import random
import zlib

import numpy as np
import pytest

from annot.llm.periodic_runs import automaton_runs, collapsed, op13_periodic_runs, periodic_runs, planted_order, stretches

from .cases import crowded, odd_rows, table


def plain_runs(word, least=6, periods=4):
    """Every run by trying each period at each place."""
    n, out = len(word), []
    for q in range(1, n // periods + 1):
        i = q
        while i < n:
            j = i
            while j < n and word[j] == word[j - q]:
                j += 1
            if j > i:
                a, length = i - q, j - i + q
                own = word[a:j]
                if length >= max(least, periods * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.append((a, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    letters = rng.choice([1, 2, 3, 6])
    word = [rng.randint(0, letters) for _ in range(rng.randint(0, 70))]
    for _ in range(rng.randint(0, 3)):
        unit = [rng.randint(0, letters) for _ in range(rng.randint(1, 8))]
        at = rng.randint(0, len(word))
        word[at:at] = (unit * 7)[: rng.randint(3 * len(unit), 6 * len(unit))]
    return word


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        word = periodic_words(rng)
        assert sorted(automaton_runs(word), key=lambda r: (r[0], r[2])) == plain_runs(word)


def test_no_run_lies_outside_the_stretches():
    rng = random.Random(2)
    for _ in range(300):
        texts = [periodic_words(rng) for _ in range(4)]
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        codes = np.array([x for t in texts for x in t], np.int64)
        spans = stretches(codes, starts).tolist()
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        for s, t in zip(starts, texts, strict=False):
            for a, length, _ in plain_runs(t):
                assert any(x <= s + a and s + a + length <= y for x, y in spans)


def test_long_periodic_words_take_no_square_of_time():
    rng = random.Random(3)
    unit = [rng.randint(0, 300) for _ in range(700)]
    assert automaton_runs((unit * 100)[:60_000]) == [(0, 60_000, 700)]
    assert automaton_runs([1] * 60_000) == [(0, 60_000, 1)]


@pytest.mark.parametrize("words", [[], ["a"], ["a"] * 5, ["a"] * 6, ["a", "b"] * 4, ["a", "b"] * 3 + ["a"]])
def test_collapsed_keeps_one_period(words):
    raw = [w.encode() for w in words]
    runs = plain_runs(words)
    kept = collapsed(raw, runs)
    assert len(kept) == (runs[0][2] if runs else len(words)) and kept == raw[: len(kept)]


def expected(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {i for a, length, q in runs for i in range(a + q, a + length)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        out.append((str(doc_id), len(runs), *best, runs and 1000 * best[1] // best[2] or None, sha("".join(f"{a},{length},{q}\n" for a, length, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=repr)


def saved(df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(f"w{x}" for x in periodic_words(rng)) for _ in range(120)]
    rows = [*enumerate(texts), *[(i, t) for i, t in odd_rows() if t is None or len(t) < 1000], (200, "é é é é é é é"), (201, "x y " * 60 + "z"), (201, "x y " * 60 + "z"), (202, "a\x1cb a b " * 9)]
    rows = [(i, t) for i, t in rows]
    got = op13_periodic_runs(spark, saved(crowded(table(spark, rows)), tmp_path))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted([(str(r[0]), *r[1:]) for r in got.select(*columns).collect()], key=repr) == expected(rows)


def test_planted_order_and_empty_table(spark):
    planted = [i for i in range(1000) if planted_order(i, 50) is not None]
    assert 60 < len(planted) < 140 and planted_order(planted[0], 0) is None and planted_order(None, 9).tolist() == [0, 1, 2, 3] * 2 + [0]
    assert periodic_runs(table(spark, []).where("false")).collect() == []


def test_texts_of_many_groups_and_other_columns(spark):
    rows = [(i, f"k{i} " * 10 + "tail") for i in range(50)] + [(99, "the same words " * 50_000)]
    found = {r.doc_id: r for r in periodic_runs(crowded(table(spark, rows))).collect()}
    assert [tuple(x) for x in found[7].runs] == [(0, 10, 1)] and found[7].collapsed == "k7 tail"
    assert tuple(found[99].best) == (0, 150_000, 3) and found[99].collapsed == "the same words"
