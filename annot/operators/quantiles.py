"""Exact quantiles by selection: histograms are counted, narrowed to the bins that hold a rank, and counted again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annot.sources.shared import written

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
#: Bins of a power of two in the first histogram, and of a bin of the one before in the others.
FINE, BINS = 512, 65_536
#: Beyond the bins of all finite values.
_EDGE = 2 * 2200 * FINE


def beside(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what is known of their group; without keys, groups is one row."""
    return rows.join(groups, keys) if keys else rows.crossJoin(F.broadcast(groups))


def _first_bin(v: Column) -> Column:
    """A bin by sign and magnitude, ordered as the values are: zero is alone, infinities and NaN (the largest) are at the ends."""
    size = F.floor(F.log2(F.abs(v)) * FINE).cast("long") + F.lit(1100 * FINE)
    return F.when(F.isnan(v) | (v == float("inf")), F.when(F.isnan(v), _EDGE).otherwise(_EDGE - 1)).when(v == float("-inf"), -_EDGE).when(v == 0, 0).when(v > 0, size).otherwise(-size)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float] = QUARTILES, weight: str | None = None) -> DataFrame:
    """keys, n and a column for each quantile, with linear interpolation. Null values and rows with null keys are left out.

    A row counts `weight` times, if given. Without keys there is always one row, with n = 0 where there are no values.

    The first histogram of each group has bins by magnitude, with their least and largest value; each later one divides the
    bins that hold a rank sought into 65,536 of equal width. It ends when these bins have one value each: after one or two
    more as a rule. Values are never sorted, and no task holds a group's: a histogram's rows are a bin each, and a group's
    are limited by the first one's bins. Few groups are sent to the rows, many are joined.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    if keys:
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    rows = rows.select(*keys, v.alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w"))
    ranks = {f"_{q}_{side}": (p, side) for q, p in probs.items() for side in ("lo", "hi")}

    def rank(name: str) -> Column:
        p, side = ranks[name]
        return (F.floor if side == "lo" else F.ceil)((F.col("n") - 1) * F.lit(float(p))).cast("long")

    def found(bins: DataFrame) -> DataFrame:
        """Of bins (keys, n, _from, _c, _a, _b) that of each rank: its ends and the number of values before it."""
        here = lambda r: (F.col("_from") <= r) & (r < F.col("_from") + F.col("_c"))
        return bins.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *[F.max(F.when(here(rank(x)), F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"), F.col("_from").alias("from")))).alias(x) for x in ranks])

    bins = rows.groupBy(*keys, _first_bin(F.col("_v")).alias("_bin")).agg(F.sum("_w").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    before = Window.partitionBy(*keys).orderBy("_bin")
    bins = bins.withColumns({"_from": F.sum("_c").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"), "n": F.sum("_c").over(Window.partitionBy(*keys))})

    def kept(groups: DataFrame) -> DataFrame:
        """With the bins that still have several values."""
        several = F.array_distinct(F.array_compact(F.array(*[F.when(F.col(f"{c}.a") < F.col(f"{c}.b"), F.col(c)) for c in ranks])))
        return written(groups.withColumn("_open", several), "quantiles")

    groups = kept(found(bins))
    while groups.where(F.size("_open") > 0).limit(1).count():
        open_ = groups.select(*keys, "n", F.explode("_open").alias("_t"))
        within = beside(rows, open_, keys).where((F.col("_t.a") <= F.col("_v")) & (F.col("_v") <= F.col("_t.b")))
        place = F.least(F.floor((F.col("_v") - F.col("_t.a")) / (F.col("_t.b") - F.col("_t.a")) * BINS), F.lit(BINS - 1)).cast("int")
        bins = within.groupBy(*keys, "n", F.col("_t.from").alias("_base"), place.alias("_bin")).agg(F.sum("_w").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = Window.partitionBy(*keys, "_base").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        narrow = found(bins.withColumn("_from", F.col("_base") + F.sum("_c").over(before) - F.col("_c")))
        narrow = narrow.select(*keys, *[F.col(c).alias(f"{c}_") for c in ranks])
        both = groups.join(narrow, keys, "left") if keys else groups.crossJoin(narrow)
        groups = kept(both.select(*keys, "n", *[F.coalesce(f"{c}_", c).alias(c) for c in ranks]))
    part = lambda p: (F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))
    low, high = (lambda q: F.col(f"_{q}_lo.a")), (lambda q: F.col(f"_{q}_hi.a"))
    return groups.select(*keys, "n", *[(F.when(low(q) == high(q), low(q)).otherwise(low(q) + (high(q) - low(q)) * part(p))).alias(q) for q, p in probs.items()])


def describe(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, n, mean, std, min, quartiles and max of the values that aren't null; a group without any has no row.

    A row counts `weight` times, if given.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull())
    if keys:
        rows = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
    if weight is None:
        stats = rows.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    else:
        w = F.col(weight)
        means = rows.groupBy(*keys).agg(F.sum(w).alias("_n"), (F.sum(v * w) / F.sum(w)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"))
        off = beside(rows, means.select(*keys, F.col("mean").alias("_mean")), keys).groupBy(*keys).agg(F.sum((v - F.col("_mean")) ** 2 * w).alias("_off"))
        stats = beside(means, off, keys).select(*keys, "mean", F.sqrt(F.col("_off") / F.when(F.col("_n") > 1, F.col("_n") - 1)).alias("std"), "min", "max")
    return beside(exact_quantiles(rows, keys, value, weight=weight), stats, keys)
