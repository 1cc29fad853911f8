"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annot.sources.shared import shared_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word, wherever the contracts count words.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. For pure ASCII, lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def seeded(*parts: Column) -> Column:
    """A non-negative 60-bit integer from the md5 of the parts, the same in any SQL engine."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def with_key(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """df with _k and _h, which tell rows apart by id and text: the id as text, and a hash of the text."""
    return df.withColumn("_k", F.coalesce(F.col(doc_id).cast("string"), F.lit("~"))).withColumn("_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def take_rows(df: DataFrame, chosen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of df as often as chosen (_k, _h, n, times) says: n rows of df have this id and text, of which `times` are taken."""
    out = with_key(df, doc_id, text).join(chosen.where("times > 0"), ["_k", "_h"])
    if chosen.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["_k", "_h"])
    if chosen.where("times > 1").limit(1).count():
        out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return out.select(*df.columns)
