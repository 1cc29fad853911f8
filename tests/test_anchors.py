"""Maximal texts by the stretches between anchors, against brute force, and how many rows near copies make."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from annot.operators import anchors, dedup
from annot.sources import shared


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, seq string").repartition(3)


def maximal(texts):
    first = {}
    for i, t in enumerate(texts):
        if t and t.strip(" "):
            first.setdefault(t, i)
    return sorted(i for t, i in first.items() if not any(t != u and t in u for u in first))


def kept(spark, texts):
    return sorted(r.id for r in dedup.dedup_containment(frame(spark, texts), "id", "seq", by="words").collect())


@pytest.mark.parametrize("letters", ["a", "ab", "é x", "acgt", "abcdefghij klmno\n"])
def test_parts_of_all_sizes(spark, letters):
    rng = random.Random(len(letters))
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    long = [text(rng.choice([1, 3, 9, 40, 200, 900])) for _ in range(60)] + [text(7) * 90, "ab" * 300, text(5000)]
    parts = [t[a : a + rng.choice([1, 2, 5, 7, 8, 9, 12, 23, 30, 100, 128, 129, 140, 400, len(t)])] for t in long * 4 for a in (rng.randint(0, len(t) - 1),)]
    edges = [x for t in long for x in (t[:-1], t[1:], t + "!", t[: len(t) // 2] + "?" + t[len(t) // 2 + 1 :])]
    texts = [*long, *parts, *edges, None, "", " ", "\n", "\n ", long[0], "ab" * 200, "ba" * 17, "a" * 64]
    assert kept(spark, texts) == maximal(texts)


def test_texts_are_looked_at_alone_or_together(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.choice([1, 6, 7, 8, 20, 128, 129, 500]))).encode() for _ in range(80)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(80), pa.int64()), pa.array(texts, pa.binary())], names=["id", "seq"])
    both, rows = [], lambda batches: sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=str)
    for size in (1, 1000, 1 << 20):
        monkeypatch.setattr(anchors, "LOOK_BYTES", size)
        known = SimpleNamespace(value=b"\xff" * 4096)
        counts = {0: np.arange(1, 122), 4: np.arange(1, 33), 6: np.array([2, 5, 9])}
        both.append((rows(anchors._ask([batch.slice(3)])), sorted({*rows(anchors._look(known, counts, [1, 3, 7])([batch.slice(3)]))}, key=str)))
    assert both[0] == both[1] == both[2] and len(both[0][1]) > 5000


def test_anchors_of_a_part_are_those_of_the_whole():
    rng = random.Random(3)
    for letters in ["ab", "abcdefgh", "the cat "]:
        whole = "".join(rng.choice(letters) for _ in range(700)).encode() + b"x" * 60 + b"the cat " * 20
        for _ in range(60):
            a = rng.randint(0, len(whole) - 40)
            part = whole[a : a + rng.randint(30, 400)]
            two = anchors._Texts(np.frombuffer(whole + part, np.uint8), np.array([len(whole), len(whole) + len(part)]))
            two.measure()
            places = len(part) - anchors.PLACE + 1
            for level in range(anchors.LOW, places.bit_length()):
                at = two.at[two.rule >= 1 << level]
                own = at[at >= len(whole)] - len(whole)
                there = at[(at >= a + own[0]) & (at <= a + own[-1])] - a
                assert own.tolist() == there.tolist()


def test_near_copies_do_not_meet(spark, monkeypatch):
    made = []
    for module in (dedup, anchors):
        monkeypatch.setattr(module, "written", lambda df, name: made.append(shared.written(df, name)) or made[-1])
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    base = [rng.choice(words) for _ in range(200)]
    texts = []
    for i in range(150):
        near = base.copy()
        near[rng.randint(30, 170)] = f"w{i}"
        texts.append(" ".join(near + ["more"] * (i % 20)))
    texts += [texts[i][20 + i : 700 + i] for i in range(10)]
    assert kept(spark, texts) == maximal(texts)
    assert sum(d.count() for d in made) < 6 * len(texts)


def test_texts_of_two_runs_do_not_meet_at_every_repeat(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(anchors, "written", lambda df, name: made.setdefault(name, shared.written(df, name)))
    texts = [f"{a} " * (60 + i) + f"{b}, " * (150 - i) for i in range(40) for a, b in (("az", "mzqm"), ("Twci", "du"))]
    texts += ["az " * 30 + "mzqm, " * 20, "Twci " * 9 + "du"]
    assert kept(spark, texts) == maximal(texts)
    assert made["found"].count() < 3 * len(texts)


def test_equal_ids_and_ids_that_are_null(spark):
    rows = [(1, "the cat sat on the mat"), (1, "the cat sat"), (None, "cat sat on"), (None, "a dog lay on the floor"), (7, "a dog lay on the floor"), (3, "og"), (2, "x")]
    out = dedup.dedup_containment(spark.createDataFrame(rows, "id long, seq string"), "id", "seq", by="words")
    assert sorted((r.id, r.seq) for r in out.collect()) == [(1, "the cat sat on the mat"), (2, "x"), (7, "a dog lay on the floor")]
