"""What holds at the minimum of the softmax classifier's loss, and only there."""

import numpy as np
from pyspark.sql import functions as F

from annot.operators import classify


def rows(spark, n=180):
    rng = np.random.default_rng(5)
    y = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(3, 4))[y] + rng.normal(size=(n, 4))
    return spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(n)], "i long, embedding array<double>, label_index double"), x, y


def test_a_fitted_model_is_level_and_an_early_one_is_not(spark):
    df, x, y = rows(spark)
    model = classify.fit_softmax(df, tol=1e-10)
    got = {r["class"]: r for r in classify.fit_balance(model, df).collect()}
    assert sorted(got) == [0, 1, 2]
    assert all(abs(got[c].expected - (y == c).sum()) < 0.01 and got[c].slope < 1e-5 for c in got)
    early = classify.fit_softmax(df, max_iter=1)
    w, b = early.coefficientMatrix.toArray(), early.interceptVector.toArray()
    z = x @ w.T + b
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    slope = np.abs((p - np.eye(3)[y]).T @ x / len(x) + w / len(x)).max(1)
    got = {r["class"]: r for r in classify.fit_balance(early, df).collect()}
    assert np.allclose([got[c].slope for c in range(3)], slope, rtol=1e-9, atol=1e-12) and max(slope) > 1e-3
    assert np.allclose([got[c].expected for c in range(3)], p.sum(0))


def test_odd_rows(spark):
    df, _, _ = rows(spark, 60)
    model = classify.fit_softmax(df)
    want = sorted(map(tuple, classify.fit_balance(model, df).collect()))
    odd = df.unionByName(spark.createDataFrame([(None, None, 1.0), (7, [0.0] * 4, None)], df.schema)).withColumn("p", F.lit("more"))
    assert np.allclose(sorted(map(tuple, classify.fit_balance(model, odd).collect())), want)
    assert classify.fit_balance(model, df.where("false")).collect() == []


def test_models_of_folds_and_conditions(spark):
    df, _, y = rows(spark, 90)
    seen = [(train.count(), test.count()) for _, train, test in classify.fold_models(df, "label_index", "i")]
    assert [a + b for a, b in seen] == [90] * 3 and sum(b for _, b in seen) == 90
    found = [(name, train.count(), held.count()) for name, _, train, held in classify.condition_models({"all": df, "none": None, "empty": df.where("false")}, "i", "label_index")]
    assert found == [("all", 72, 18)]
