"""Joins that build and enrich the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annot.operators.quantiles import beside, exact_quantiles


def reindex(df: DataFrame, key: str, spine: list, fill=0) -> DataFrame:
    """A row for each value of the spine, in its order (pos); other columns are filled where df has no row."""
    kind = df.schema[key].dataType
    rows = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(spine)], f"`{key}` {kind.simpleString()}, pos int")
    out = rows.join(df, key, "left")
    return out.fillna(fill, [c for c in df.columns if c != key])


def combine_reports(iso: DataFrame, main: DataFrame, structs: DataFrame, on: list[str] = ("GenomeID", "tRNAscanID")) -> DataFrame:
    """Rows in both reports; what structures say of them, '' where they say nothing."""
    out = iso.join(main, list(on)).join(structs, list(on), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in structs.columns if c not in on})


def add_taxonomy(df: DataFrame, taxonomy: DataFrame, key: str = "accession") -> DataFrame:
    """Left join of the ranks. Spark broadcasts the dimension if it is small enough."""
    return df.join(taxonomy, key, "left")


def match_stats(df: DataFrame, probe: str, key: str) -> DataFrame:
    """Rows, matched rows (probe isn't null), their share and the distinct keys without a match."""
    hit = F.col(probe).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(hit).alias("n_matched"), (100.0 * F.count_if(hit) / F.count(F.lit(1))).alias("pct_matched"), F.count_distinct(F.when(~hit, F.col(key))).alias("n_unmatched_keys"))


def filter_to_representatives(df: DataFrame, representatives: DataFrame, key: str) -> DataFrame:
    """All rows whose key is a representative's."""
    return df.join(representatives.select(key), key, "left_semi")


def pending_inputs(inputs: DataFrame, outputs: DataFrame, key: str, kind: str, size: str, kinds: int) -> DataFrame:
    """Inputs whose outputs aren't all there: of `kinds` kinds, each with a size above 0."""
    done = outputs.where(F.col(size) > 0).groupBy(key).agg(F.count_distinct(kind).alias("n")).where(F.col("n") >= kinds)
    return inputs.join(done.select(key), key, "left_anti")


def attach_labels(df: DataFrame, labels: DataFrame, key: str, label: str, ordinal: str, default) -> DataFrame:
    """Left join of labels: of several for a key the last one counts; default where there is none."""
    last = labels.groupBy(key).agg(F.max_by(label, ordinal).alias(label))
    return df.join(last, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def paired_delta(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows a key in both tables, before and after, and the difference."""
    before, after = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "n_before"), (b, "n_after")))
    return before.join(after, key).withColumn("delta", F.col("n_after") - F.col("n_before"))


def delta_medians(deltas: DataFrame, a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """median_before and median_after of the rows a key, over all keys of each table, and median_delta over common ones."""
    def median(df: DataFrame, column: str, name: str) -> DataFrame:
        return exact_quantiles(df, [], column, {name: 0.5}).select(name)

    before, after = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")) for df in (a, b))
    return beside(beside(median(before, "n", "median_before"), median(after, "n", "median_after"), []), median(deltas, "delta", "median_delta"), [])
