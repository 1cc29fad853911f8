"""Statistics by group of units: genomes by taxon, orders by nation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annot.operators.profile import top_k
from annot.operators.quantiles import exact_quantiles


def units_per_group(df: DataFrame, group: str, unit: str) -> DataFrame:
    """Distinct units of each group, most first."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(unit).alias("n_units")).orderBy(F.col("n_units").desc(), group)


def top_groups(df: DataFrame, group: str, unit: str, n: int) -> DataFrame:
    return units_per_group(df, group, unit).limit(n)


def within(df: DataFrame, group: str, unit: str, n: int | None) -> DataFrame:
    """Rows of the n groups with most units; all with a group if n is None."""
    rows = df.where(F.col(group).isNotNull())
    return rows if n is None else rows.join(top_groups(df, group, unit, n).select(group), group, "left_semi")


def rows_per_unit_by(df: DataFrame, unit: str, group: str, n: int | None = None) -> DataFrame:
    """group, n_units, and of the rows a unit: min, quartiles, max. Groups with most units first."""
    per = within(df, group, unit, n).groupBy(group, unit).agg(F.count(F.lit(1)).alias("rows"))
    ends = per.groupBy(group).agg(F.min("rows").alias("min"), F.max("rows").alias("max"))
    out = exact_quantiles(per, [group], "rows", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).join(ends, group)
    return out.select(group, F.col("n").alias("n_units"), "min", "q25", "q50", "q75", "max").orderBy(F.col("n_units").desc(), group)


def _per_unit(df: DataFrame, unit: str, group: str, category: str, n: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = within(df, group, unit, n).where(F.col(unit).isNotNull())
    parts = rows.groupBy(group, unit, category).agg(F.count(F.lit(1)).alias("n"))
    totals = parts.groupBy(group, unit).agg(F.sum("n").alias("total"))
    return parts, totals, totals.groupBy(group).agg(F.count(F.lit(1)).alias("units"))


def composition_by_group(df: DataFrame, unit: str, group: str, category: str, exclude: list[str] = (), n: int | None = None) -> DataFrame:
    """group, category, mean_pct: a category's share of a unit's rows, averaged over the group's units."""
    rows = df.where(F.col(category).isNotNull() & ~F.col(category).isin(list(exclude))) if exclude else df.where(F.col(category).isNotNull())
    parts, totals, units = _per_unit(rows, unit, group, category, n)
    shares = parts.join(totals, [group, unit]).groupBy(group, category).agg(F.sum(100.0 * F.col("n") / F.col("total")).alias("s"))
    return shares.join(units, group).select(group, category, (F.col("s") / F.col("units")).alias("mean_pct"))


def mean_count_matrix(df: DataFrame, unit: str, group: str, category: str, n: int | None = None) -> DataFrame:
    """group, category, mean_count: a category's rows a unit, units without any counted."""
    parts, _, units = _per_unit(df.where(F.col(category).isNotNull()), unit, group, category, n)
    return parts.groupBy(group, category).agg(F.sum("n").alias("n")).join(units, group).select(group, category, (F.col("n") / F.col("units")).alias("mean_count"))


def group_parent(df: DataFrame, child: str, parent: str, order_by: str) -> DataFrame:
    """The parent of each child: that of its first row which has one."""
    rows = df.where(F.col(child).isNotNull() & F.col(parent).isNotNull())
    return rows.groupBy(child).agg(F.min_by(parent, order_by).alias(parent))


def order_groups(df: DataFrame, group: str, parent: str, unit: str, order_by: str) -> DataFrame:
    """group, parent, n_units, ordered by parent and then by units, most first."""
    return units_per_group(df, group, unit).join(group_parent(df, group, parent, order_by), group, "left").orderBy(parent, F.col("n_units").desc(), group)


def prevalence(df: DataFrame, unit: str, group: str, predicate: Column, n: int | None = None) -> DataFrame:
    """group, n_units, pct: the share of units with a row for which the predicate holds; one pass."""
    out = within(df, group, unit, n).groupBy(group).agg(F.count_distinct(unit).alias("n_units"), F.count_distinct(F.when(predicate, F.col(unit))).alias("hit"))
    return out.select(group, "n_units", (100.0 * F.col("hit") / F.col("n_units")).alias("pct"))


def flag_rate(df: DataFrame, flag: Column, group: str, unit: str, n: int | None = None) -> DataFrame:
    """group and pct: the share of rows with the flag, null counting as no."""
    rows = within(df, group, unit, n)
    return rows.groupBy(group).agg((100.0 * F.avg(F.coalesce(flag, F.lit(False)).cast("int"))).alias("pct"))


def share_by_group(df: DataFrame, category: str, group: str, k: int, denominator: str = "subset") -> DataFrame:
    """group, category, pct over the k most frequent categories; of their rows, or of all the group's (denominator='all')."""
    top = top_k(df, category, k).select(F.col("value").alias(category))
    rows = df.where(F.col(group).isNotNull() & F.col(category).isNotNull())
    some = rows.join(top, category, "left_semi")
    counts = some.groupBy(group, category).agg(F.count(F.lit(1)).alias("n"))
    base = (some if denominator == "subset" else df.where(F.col(group).isNotNull())).groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return counts.join(base, group).select(group, category, (100.0 * F.col("n") / F.col("total")).alias("pct"))
