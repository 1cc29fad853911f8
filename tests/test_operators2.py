"""Quantiles by rank, folds, containment, headers, classes without rows, and the softmax classifier against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annot.functions import text as fn
from annot.operators import classify, combine, compare, dedup, profile
from annot.operators.quantiles import describe, exact_quantiles
from annot.sources import reports
from annot.sources.shared import new_path


def test_quantiles_by_rank(spark):
    rng = random.Random(5)
    data = [(k, rng.choice([1.0, 2.0, rng.random() * 10, None])) for k in "abc" for _ in range({"a": 1, "b": 50, "c": 900}[k])] + [("d", None), (None, 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in describe(df, ["k"], "v").collect()}
    for k in "abc":
        v = [x for y, x in data if y == k and x is not None]
        if not v:
            assert k not in got
            continue
        r = got[k]
        assert (r.n, r.min, r.max) == (len(v), min(v), max(v))
        assert np.allclose([r.p25, r.p50, r.p75], np.quantile(v, [0.25, 0.5, 0.75]), rtol=1e-12)
    assert None not in got and "d" not in got
    whole = exact_quantiles(df, [], "v", {"lo": 0.0, "x": 0.9, "hi": 1.0}).head()
    v = [x for _, x in data if x is not None]
    assert whole.n == len(v) and np.allclose([whole.lo, whole.x, whole.hi], np.quantile(v, [0, 0.9, 1]))
    none = exact_quantiles(df.where("v > 99"), [], "v").collect()
    assert len(none) == 1 and none[0].n == 0 and none[0].p50 is None


def test_folds_and_null_labels(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else "small") for i in range(60)]
    out = classify.stratified_folds(spark.createDataFrame(rows, "i long, label string"), "label", "i").collect()
    assert len(out) == 60
    for label in ("big", "small", None):
        sizes = [sum(r.label == label and r.fold == f for r in out) for f in range(3)]
        assert max(sizes) - min(sizes) <= 1


def test_containment_by_brute_force(spark):
    rng = random.Random(3)
    letters = {"".join(rng.choice("AC") for _ in range(rng.randint(1, 30))) for _ in range(120)}
    df = spark.createDataFrame(list(enumerate(sorted(letters))), "id long, seq string")
    texts = dict(enumerate(sorted(letters)))
    want = sorted((i, j) for i, a in texts.items() for j, b in texts.items() if a != b and a in b)
    assert sorted(tuple(r) for r in dedup.containment_pairs(df, df, k=6).collect()) == want
    vocabulary = ["the", "a", "of", "xx", "y"]
    whole = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(60)]
    some = [w[rng.randrange(len(w)) :][: rng.randint(1, 40)] for w in whole] + ["", "the a", "of"]
    short, long = (spark.createDataFrame(list(enumerate(x)), "id long, seq string") for x in (some, whole))
    want = sorted((i, j) for i, a in enumerate(some) for j, b in enumerate(whole) if a and a != b and a in b)
    assert sorted(tuple(r) for r in dedup.containment_pairs(short, long, by="words").collect()) == want


def test_one_hot_of_odd_sequences(spark):
    df = spark.createDataFrame([("acguX",), ("",), (None,), ("A" * 9,), ("\U0001f600T",)], "s string")
    got = [np.array(r[0]).reshape(6, 5) for r in df.select(fn.one_hot(F.col("s"), 6)).collect()]
    assert got[0].argmax(1).tolist()[:5] == [0, 1, 2, 3, 4] and got[0].sum() == 5
    assert got[1].sum() == got[2].sum() == 0
    assert got[3].sum() == 6 and got[4].argmax(1).tolist()[:2] == [4, 3]


def test_reports_are_read_by_their_own_headers(spark):
    path = new_path(spark, "headers")
    heads = {"g1": "Name\ttRNA #\tBegin\tEnd\tType\tCodon\tBegin\tEnd\tScore\tCM\tScore\tNote", "g2": "tRNA #\tName\tScore\tExtra\tBegin"}
    lines = {"g1": "c\t1\t5\t9\tAla\tTGC\t6\t7\t50\tx\t60\tpseudo", "g2": "2\td\t70\tmore\t8"}
    rows = [(f"{g}.trnascan.out", "\n".join(["first", heads[g], "---", lines[g], lines[g].split("\t")[0]])) for g in heads]
    spark.createDataFrame(rows, "name string, text string").write.partitionBy("name").text(path)
    got = {r.GenomeID: r for r in reports.read_scan_report(spark, path).where("tRNAscanID not like '%.trna'").collect() if r.tRNAscanID != ".trna2"}
    assert (got["g1"].tRNAscanID, got["g1"].intron_begin, got["g1"].conf_score, got["g1"].Note) == ("c.trna1", "6", "60", "pseudo")
    assert (got["g2"].tRNAscanID, got["g2"].Score, got["g2"].Begin, got["g2"].End, got["g2"].conf_score) == ("d.trna2", "70", "8", None, None)


def test_spines_medians_and_classes(spark):
    a = spark.createDataFrame([("x",)] * 4 + [("y",)] * 2 + [("z",)], "k string")
    b = spark.createDataFrame([("x",)] * 3 + [("y",)], "k string")
    got = {r.value: r for r in compare.compare_distribution(a, b, "k", ["x", "q", "y"]).collect()}
    assert sorted(got) == ["q", "x", "y"] and got["q"].pct_change is None and got["x"].mean_change == -37.5 and got["q"].n_before == 0
    m = combine.delta_medians(combine.paired_delta(a, b, "k"), a, b, "k").collect()
    assert [tuple(r) for r in m] == [(2.0, 2.0, -1.0)]
    told = spark.createDataFrame([(0, 0), (0, 1)], "t int, p int")
    got = {r["class"]: (r.recall, r.support) for r in classify.per_class_metrics(told, "t", "p", [0, 2]).collect()}
    assert got == {0: (0.5, 2), 2: (0.0, 0)}
    assert profile.describe_exact(spark.createDataFrame([], "v double"), ["v"]).count() == 0


def plain_softmax(x, y, classes, c=1.0, steps=4000):
    """c times the sum of losses plus half the squared norm, by gradient descent with momentum; the bias is free."""
    w, b, mw, mb = np.zeros((x.shape[1], classes)), np.zeros(classes), 0, 0
    hot = np.eye(classes)[y]
    rate = 1 / (c * len(x) * (np.square(x).sum(1).max() + 1) / 2 + 1)
    for _ in range(steps):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = c * (p - hot)
        mw, mb = 0.95 * mw - rate * (x.T @ g + w), 0.95 * mb - rate * g.sum(0)
        w, b = w + mw, b + mb
    return w, b


def test_softmax_against_numpy(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(3, 5))
    y = rng.integers(0, 3, 240)
    x = centres[y] + rng.normal(size=(240, 5)) * 0.9
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(240)], "i long, embedding array<double>, label_index double")
    split = {r.i: r.is_test for r in classify.holdout_split(df, "i").collect()}
    rows = classify.holdout_split(df, "i")
    train = np.array([not split[i] for i in range(240)])
    w, b = plain_softmax(x[train], y[train], 3)
    model = classify.fit_softmax(rows.where(~F.col("is_test")))
    got = {r.i: int(r.prediction) for r in classify.predict(model, rows.where("is_test")).collect()}
    want = (x @ w + b).argmax(1)
    assert len(got) == 48 and np.mean([got[i] == want[i] for i in got]) > 0.97
    assert np.allclose(model.coefficientMatrix.toArray() - model.coefficientMatrix.toArray().mean(0), (w - w.mean(1, keepdims=True)).T, atol=0.02)
    folds = {r.i: r.fold for r in classify.stratified_folds(df, "label_index", "i").collect()}
    scores = []
    for f in range(3):
        t = np.array([folds[i] != f for i in range(240)])
        w, b = plain_softmax(x[t], y[t], 3)
        scores.append(((x[~t] @ w + b).argmax(1) == y[~t]).mean())
    cv = classify.cross_validate(df, "label_index", "i").head()
    assert abs(cv.cv_mean - np.mean(scores)) < 0.015 and abs(cv.cv_std - np.std(scores)) < 0.02
    metrics, summary = classify.compare_conditions({"all": df, "none": None}, "label_index", "i")
    s = summary.collect()
    assert [(r.condition, r.n_test) for r in s] == [("all", 48)] and abs(s[0].test_acc - np.mean([got[i] == y[i] for i in got])) < 0.001
    assert {r["class"] for r in metrics.collect()} == {0.0, 1.0, 2.0}
    with pytest.raises(ValueError):
        classify.compare_conditions({"none": None}, "label_index", "i")
