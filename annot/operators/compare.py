"""Comparing a table before and after a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annot.operators.clean import tag
from annot.operators.combine import reindex
from annot.operators.profile import histogram, top_k
from annot.operators.quantiles import beside


def tagged(before: DataFrame, after: DataFrame) -> DataFrame:
    return tag(before, "before").unionByName(tag(after, "after"))


def compare_overview(before: DataFrame, after: DataFrame, units: dict[str, str]) -> DataFrame:
    """stat, n_before, n_after, pct_removed: of rows and of the distinct values of each unit."""
    rows = tagged(before, after).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(n) for n, c in units.items()])
    long = rows.select("dataset", F.explode(F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).alias("v")) for n in ("n_rows", *units)])).alias("x"))
    out = long.groupBy(F.col("x.stat").alias("stat")).agg(*[F.max(F.when(F.col("dataset") == d, F.col("x.v"))).alias(f"n_{d}") for d in ("before", "after")])
    return out.withColumn("pct_removed", F.try_divide(100.0 * (F.col("n_before") - F.col("n_after")), F.col("n_before")))


def compare_distribution(before: DataFrame, after: DataFrame, column: str, spine: list | None = None) -> DataFrame:
    """value, n_before, n_after, pct_change (null for values that were not there) and mean_change, its mean over all rows.

    With a spine, its values and no others have a row, in its order (pos), zeros where neither table has them.
    """
    rows = tagged(before.select(column), after.select(column)).where(F.col(column).isNotNull())
    out = rows.groupBy(F.col(column).alias("value")).agg(*[F.count_if(F.col("dataset") == d).alias(f"n_{d}") for d in ("before", "after")])
    if spine is not None:
        out = reindex(out, "value", spine)
    out = out.withColumn("pct_change", F.try_divide(100.0 * (F.col("n_after") - F.col("n_before")), F.col("n_before")))
    return beside(out, out.agg(F.avg("pct_change").alias("mean_change")), [])


def compare_histogram(before: DataFrame, after: DataFrame, column: str, bins: int) -> DataFrame:
    """Densities of a column in both tables, each over its own range."""
    return histogram(tagged(before.select(column), after.select(column)), column, bins, density=True, by="dataset")


def compare_share(before: DataFrame, after: DataFrame, column: str, k: int) -> DataFrame:
    """value, pct_before, pct_after, shift over the k most frequent values of the first table; shares of these rows."""
    top = top_k(before, column, k).select(F.col("value").alias(column))
    rows = tagged(before.select(column), after.select(column)).join(top, column, "left_semi")
    counts = rows.groupBy(F.col(column).alias("value")).agg(*[F.count_if(F.col("dataset") == d).alias(d) for d in ("before", "after")])
    total = counts.agg(F.sum("before").alias("tb"), F.sum("after").alias("ta"))
    out = beside(counts, total, []).select("value", (100.0 * F.col("before") / F.col("tb")).alias("pct_before"), (100.0 * F.col("after") / F.col("ta")).alias("pct_after"))
    return out.withColumn("shift", F.col("pct_after") - F.col("pct_before"))


def compare_flags(before: DataFrame, after: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """dataset and the rate of each flag, in percent."""
    return tagged(before, after).groupBy("dataset").agg(*[(100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("int"))).alias(n) for n, c in flags.items()])
