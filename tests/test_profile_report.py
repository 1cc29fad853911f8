"""Quantiles by selection, with weights and odd values, and the report of a table that is read once."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from annot.operators import profile
from annot.operators.quantiles import describe, exact_quantiles


def test_selection_over_all_magnitudes(spark):
    rng = random.Random(1)
    values = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-300, 300) for _ in range(400)] + [0.0, -0.0, 5e-324, -5e-324, 1.7e308, 1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)] * 3
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    probs = {f"q{i}": i / 20 for i in range(21)}
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        own = sorted(v for i, v in enumerate(values) if i % 3 == r.k)
        assert r.n == len(own)
        for q, p in probs.items():
            at = (len(own) - 1) * p
            a, b = own[math.floor(at)], own[math.ceil(at)]
            assert r[q] == a or a < r[q] <= b or math.isclose(r[q], a + (b - a) * (at - math.floor(at)), rel_tol=1e-9)


def test_infinities_and_nan_are_at_the_ends(spark):
    df = spark.createDataFrame([(v,) for v in [float("nan"), float("inf"), float("-inf"), 1.0, 1.7e308]], "v double")
    r = exact_quantiles(df, [], "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 1.0}).head()
    assert (r.a, r.b, r.c, r.d) == (float("-inf"), 1.0, 1.7e308, float("inf")) and math.isnan(r.e)


def test_weights_count_as_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1.5, 2.0, 7.25, -3.0, rng.random()]), rng.randint(1, 40)) for _ in range(200)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    once = df.select("k", F.explode(F.array_repeat("v", F.col("w"))).alias("v"))
    for keys in (["k"], []):
        a, b = ({tuple(r[k] for k in keys): r for r in d.collect()} for d in (describe(df, keys, "v", weight="w"), describe(once, keys, "v")))
        assert a.keys() == b.keys() and all(np.allclose([a[k][c] for c in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")], [b[k][c] for c in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")]) for k in a)


def test_report_reads_the_table_once(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.5, 9.0]), rng.choice("pq")) for i in range(100)]
    spark.createDataFrame(data, "id int, c string, v double, g string").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    options = {"flags": {"big": F.col("v") > 2}, "exclusive": (F.col("v") > 2, F.col("g") == "p", F.col("id") < 3), "canonical": {"c": ["x"]}, "top": {"g": 1}, "shares": ("g", "c"), "quantiles": ("g", "v"), "matrix": ("c", ["v"]), "composition": ("g", "c"), "bins": 4}
    out = profile.profile_report(table, {"ids": "id"}, ["c", "g"], ["v"], "g", **options)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert f"{tmp_path}" not in plan and all("/profile-" in f or "/quantiles-" in f for f in out.inputFiles())
    got = {(r.section, r.key, r.stat): r.value for r in out.collect()}
    assert got["overview", "all", "n_rows"] == 100 and got["overview", "all", "ids"] == 100 and got["missing", "c", "n_missing"] == sum(r[1] is None for r in data)
    assert got["distribution:g", "p", "n"] == sum(r[3] == "p" for r in data) and got["flags", "big", "n"] == sum((r[2] or 0) > 2 for r in data)
    values = [r[2] for r in data if r[1] == "x" and r[2] is not None]
    assert math.isclose(got["matrix", "x", "v"], sum(values) / len(values)) and got["canonical:c", "noise", "n"] == sum(r[1] == "y" for r in data)
    assert sum(v for (s, _, stat), v in got.items() if s == "histogram:v" and stat == "n") == sum(r[2] is not None for r in data)


def test_report_of_an_empty_table(spark):
    table = spark.createDataFrame([], "id int, c string, v double, g string")
    out = profile.profile_report(table, {"ids": "id"}, ["c"], ["v"], "g", flags={"big": F.col("v") > 2}, top={"g": 1}, shares=("g", "c"), quantiles=("g", "v"), matrix=("c", ["v"]), composition=("g", "c"), bins=4)
    assert sorted((r.section, r.stat, r.value) for r in out.collect()) == [("overview", "ids", 0.0), ("overview", "n_columns", 4.0), ("overview", "n_rows", 0.0)]
