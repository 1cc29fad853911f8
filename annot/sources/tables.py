"""CSV, TSV, grouped, metrics and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annot.functions.text import safe_name
from annot.operators.combine import reindex
from annot.schema import ISOTYPES, PREFIXES, RANKS, strings


def read_table_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True, sep: str = ",") -> DataFrame:
    """All columns as strings; rows with too many fields are dropped, short ones padded with nulls."""
    schema = strings([*columns, "_overflow"])
    rows = spark.read.csv(path, schema=schema, header=header, sep=sep, mode="PERMISSIVE", enforceSchema=True)
    return rows.where(F.col("_overflow").isNull()).drop("_overflow")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df; an error if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def split_lineage(df: DataFrame, column: str, ranks: list[str] = RANKS, prefixes: list[str] = PREFIXES, strict: bool = False) -> DataFrame:
    """A column for each rank of a ';'-joined lineage. A rank's prefix goes wherever it stands; with strict, at the start only."""
    parts = F.split(F.col(column), ";")
    bare = lambda c, p: F.regexp_replace(c, f"^{p}", "") if strict else F.replace(c, F.lit(p), F.lit(""))
    return df.withColumns({r: bare(F.get(parts, F.lit(i)), p) for i, (r, p) in enumerate(zip(ranks, prefixes, strict=True))})


def read_taxonomy(spark: SparkSession, path: str, ranks: list[str] = RANKS, prefixes: list[str] = PREFIXES) -> DataFrame:
    """accession and rank columns of a two-column TSV without header; RS_ and GB_ go from the front of ids."""
    rows = spark.read.csv(path, schema=strings(["raw_id", "taxonomy"]), sep="\t", header=False)
    out = split_lineage(rows, "taxonomy", ranks, prefixes)
    return out.withColumn("accession", F.regexp_replace("raw_id", "^(RS_|GB_)", "")).select("accession", *ranks)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_grouped(df: DataFrame, group: str, path: str) -> None:
    """CSV files with headers, in a folder for each value of the group column. Two groups never share a folder.

    Rows are rebalanced by group: small groups share a task, and a large one is split over several and has several files.
    """
    df.hint("rebalance", group).write.partitionBy(group).csv(path, header=True)


def group_index(df: DataFrame, group: str) -> DataFrame:
    """group, a safe file name for it, and its number of rows, ordered by group."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select(F.col(group), F.concat(safe_name(F.col(group)), F.lit(".csv")).alias("file"), "n_rows").orderBy(group)


METRICS = ["precision", "recall", "f1_score", "support"]
SUMMARY = ["CV_mean", "CV_std", "test_acc"]


def write_metrics(per_class: DataFrame, summary: DataFrame, path: str) -> None:
    """One CSV: the rows of classes, and summary rows (name, value) with the value in the last metric column but one."""
    rows = per_class.select(F.col("class").cast("string"), *[F.col(m).cast("string") for m in METRICS])
    more = summary.select(F.col("name").alias("class"), *[F.lit(None).cast("string").alias(m) for m in METRICS[:2]], F.col("value").cast("string").alias("f1_score"), F.lit(None).cast("string").alias("support"))
    rows.unionByName(more).coalesce(1).write.csv(path, header=True)  # a few rows a class


def read_metrics(spark: SparkSession, path: str, classes: list[str] = ISOTYPES) -> tuple[DataFrame, DataFrame]:
    """Class rows, reindexed to the given classes, and summary rows (name, value)."""
    rows = spark.read.csv(path, schema=strings(["class", *METRICS]), header=True)
    numbers = rows.where(~F.col("class").isin(SUMMARY)).select("class", *[F.col(m).try_cast("double").alias(m) for m in METRICS])
    summary = rows.where(F.col("class").isin(SUMMARY)).select(F.col("class").alias("name"), F.col("f1_score").try_cast("double").alias("value"))
    return reindex(numbers, "class", classes, 0.0), summary


def write_vectors(df: DataFrame, path: str) -> None:
    """id, label, embedding as one Parquet table."""
    df.select("id", "label", F.col("embedding").cast(T.ArrayType(T.FloatType())).alias("embedding")).write.parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
