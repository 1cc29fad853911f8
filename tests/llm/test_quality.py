import random

import numpy as np

from annot.llm.quality import drop_low_quality, features, fit_bradley_terry, quality_scores

from .cases import crowded, odd_rows, table, words


def corpus(n=200):
    rng = random.Random(4)
    good = [(i, words(rng, rng.randint(5, 200)) + ".") for i in range(n)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in words(rng, rng.randint(5, 200)).split())) for i in range(n // 4)]
    return good, bad


def test_learns_from_pairs(spark):
    good, bad = corpus()
    docs = table(spark, good + bad + [(5000, None), (5001, "")])
    marked = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(3, None), (None, 1), (good[0][0], 1)], "doc_id long, label int")
    got = {r.doc_id: r for r in quality_scores(crowded(docs), marked).collect()}
    assert len(got) == len(good) + len(bad) + 2
    right = [got[i].predicted == 1 for i, _ in good[1::2]] + [got[i].predicted == 0 for i, _ in bad[1::2]]
    assert np.mean(right) > 0.98 and all(0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in drop_low_quality(crowded(docs), marked).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 1}


def test_odd_rows(spark):
    rows = odd_rows()
    none = spark.createDataFrame([], "doc_id long, label int")
    got = quality_scores(crowded(table(spark, rows)), none).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    assert quality_scores(table(spark, []), none).count() == 0
    assert features(None) == features("") == [0.0] * len(features("x"))


def test_weights_order_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + 0.01 * x[:, 1] > 0).astype(int)
    w, cut, _ = fit_bradley_terry(x, y, pairs=3000)
    assert (((x @ w) >= cut) == y).mean() > 0.98


def test_odd_rows_with_labels(spark):
    """Null, empty, repeated, very long and non-ASCII texts meet a model that was trained."""
    good, bad = corpus()
    rng = random.Random(2)
    odd = [(i and i + 7000, t) for i, t in odd_rows()] + [(6000, words(rng, 60_000) + "."), (6001, "WORD!! " * 20_000), (6002, "Ünïcode größer 世界 🙂. " + words(rng, 50)), (None, good[0][1])]
    marked = spark.createDataFrame([(i, 1) for i, _ in good[::2]] + [(i, 0) for i, _ in bad[::2]] + [(7001, 0), (7004, 1), (None, 0)], "doc_id long, label int")
    got = quality_scores(crowded(table(spark, good + bad + odd)), marked).collect()
    assert len(got) == len(good) + len(bad) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[7001] == by[7002] and len(by[7004]) == 2 and len(set(by[7004])) == 1 and by[good[0][0]][0] in by[None]
    assert by[6000][0] > 0.5 > by[6001][0]
    kept = drop_low_quality(crowded(table(spark, good + bad + odd)), marked)
    assert kept.count() == sum(r.predicted for r in got)
