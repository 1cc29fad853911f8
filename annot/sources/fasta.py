"""FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annot.functions.text import no_blanks


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (the whole header line, trimmed) and seq (its lines joined). Text before a file's first header is dropped.

    A header starts a line; a '>' elsewhere belongs to the text it stands in. Files are split, not read whole.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    rows = records.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    # Only a file's first record keeps its '>', or is text before any header.
    firsts = rows.where("block = 0").groupBy("file").agg(F.min("n").alias("first"))
    rows = rows.join(firsts, "file", "left").where((F.col("n") != F.col("first")) | F.col("value").startswith(">") | F.col("first").isNull())
    body = F.when(F.col("n") == F.col("first"), F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value"))
    parts = F.split(body, "\n", 2)
    return rows.select(F.trim(F.get(parts, F.lit(0))).alias("id"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s+", "").alias("seq"))


def write_fasta(df: DataFrame, id_col: str, seq_col: str, path: str) -> None:
    """Records with a sequence; blanks in ids become '_'."""
    rows = df.where(F.trim(F.coalesce(F.col(seq_col), F.lit(""))) != "")
    rows.select(F.concat(F.lit(">"), no_blanks(F.col(id_col)), F.lit("\n"), F.col(seq_col))).write.text(path)
