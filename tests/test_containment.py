"""Containment against brute force: a motif in a third of the texts, mixed white space, parts of long texts, and its plan."""

import random

import pytest

from annot.operators import dedup


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, seq string")


def brute(short, long):
    return sorted((i, j) for i, a in enumerate(short) for j, b in enumerate(long) if a and b and a != b and a in b)


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("k", [3, 8])
def test_motif_in_a_third_of_the_texts(spark, k):
    rng = random.Random(k)
    text = lambda n: "".join(rng.choice("ACGU") for _ in range(n))
    long = [text(40) + ("GATTACAGATTACA" if i % 3 == 0 else "") + text(rng.randint(0, 40)) for i in range(150)] + [text(700), None, ""]
    short = ["GATTACAGATTACA", "GATTACA", "A", "", None, *[t[5:30] for t in long[:20]], *[t[30:60] for t in long[:20]], long[150][240:290], long[150][:1], long[150]]
    assert pairs(dedup.containment_pairs(frame(spark, short), frame(spark, long), k=k)) == brute(short, long)


def test_words_across_any_white_space(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "a", "of", "é", "w" + str(rng.randint(0, 9))])
    text = lambda n: "".join(word() + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(n))
    long = [text(rng.randint(0, 30)) for _ in range(60)] + [text(600)] + ["the the the the the the the the the"]
    short = [t[a : a + rng.randint(1, 60)] for t in long for a in (rng.randint(0, max(len(t) - 1, 0)),)] + [long[60][1200:1500], "the the the the the the", " ", "\n", None]
    assert pairs(dedup.containment_pairs(frame(spark, short), frame(spark, long), by="words")) == brute(short, long)


def test_seeds_of_long_texts_are_made_once(spark, monkeypatch):
    made, written = [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: made.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or written(df, name))
    out = dedup.containment_pairs(frame(spark, ["ACGTACGTAC"]), frame(spark, ["ACGTACGTACGT" * 3, "TTTTACGTACGTACGA"]), k=6)
    assert pairs(out) == [(0, 0), (0, 1)] and [n for n, _ in made] == ["hits"] and "LeftSemi" in made[0][1]
    later = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(sequence(" not in later.replace("Some", "")  # seeds of long texts are read, not made again


def test_texts_of_a_word_or_two_are_found_among_distinct_words(spark, monkeypatch):
    made, written = {}, dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: made.setdefault(name, []).append(written(df, name)) or made[name][-1])
    long = ["the cat sat on the mat " * 30 + f"t{i}" for i in range(20)] + ["the", "the ", "on the", "cats at", "he cat", "t sat", " ", "at t", "sat on the mat the c"]
    assert pairs(dedup.containment_pairs(frame(spark, long), frame(spark, long), by="words")) == brute(long, long)
    kept = dedup.dedup_containment(frame(spark, long), "id", "seq", by="words")
    assert sorted(r.id for r in kept.collect()) == [i for i, t in enumerate(long) if t.strip() and not any(i == a for a, _ in brute(long, long))]
    assert sum(d.count() for d in made["hits"]) < 4000  # both calls; seeds of letters had more places in the 20 long texts


@pytest.mark.parametrize("k", [2, 4, 12])
def test_maximal_sequences_keep_few_places(spark, monkeypatch, k):
    rng, made, written = random.Random(k), [], dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: made.append((name, written(df, name))) or made[-1][1])
    long = ["".join(rng.choice("ACGT") for _ in range(64)) for _ in range(200)] + ["".join(rng.choice("ACGT") for _ in range(700))]
    texts = sorted({*long, *(t[i % 20 : i % 20 + 1 + i % 40] for i, t in enumerate(long)), long[-1][240:270], long[-1][250:500], "ACGX", "X", "N"})
    want = [i for i, a in enumerate(texts) if not any(a != b and a in b for b in texts)]
    assert sorted(r.id for r in dedup.dedup_containment(frame(spark, texts), "id", "seq", k=k).collect()) == want
    assert sum(d.count() for n, d in made if n == "hits") < 3 * 4 * len(texts)
