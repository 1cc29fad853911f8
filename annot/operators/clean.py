"""Projections and filters that clean a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annot.functions import text as fn


def drop_repeated_headers(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value isn't the column's own name; rows with null stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(column)))


def count_repeated_headers(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column) == column).alias("n_header_rows"))


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what isn't a number becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def trim_frame(df: DataFrame) -> DataFrame:
    """Trimmed column names and string values."""
    df = df.toDF(*[c.strip() for c in df.columns])
    return df.withColumns({n: F.trim(n) for n, t in df.dtypes if t == "string"})


def derive_ids(df: DataFrame, gene: str = "tRNAscanID", genome: str = "GenomeID") -> DataFrame:
    """ContigID: the gene id without .trnaN; accession: the genome id without _genomic and the prefixes RS_ and GB_."""
    return df.withColumns({
        "ContigID": F.regexp_replace(gene, r"\.trna\d+$", ""),
        "accession": F.regexp_replace(F.regexp_replace(genome, "_genomic", ""), "^(RS_|GB_)", ""),
    })


def add_flags(df: DataFrame, seq: str = "primary_sequence", intron: str = "intron_begin", note: str = "Note") -> DataFrame:
    """seq_len, has_intron, is_pseudo, is_trunc; nulls count as no."""
    text = F.coalesce(F.col(note), F.lit(""))
    return df.withColumns({
        "seq_len": F.length(F.coalesce(F.col(seq), F.lit(""))), "has_intron": F.coalesce(F.col(intron) > 0, F.lit(False)),
        "is_pseudo": text.contains("pseudo"), "is_trunc": text.contains("trunc"),
    })


def clean_category(df: DataFrame, column: str, fill: str = "Unknown") -> DataFrame:
    return df.withColumn(column, F.trim(F.coalesce(F.col(column), F.lit(fill))))


def interval_length(df: DataFrame, begin: str, end: str, lo: float = 0, hi: float = 500) -> DataFrame:
    """Adds length; rows without one go."""
    return df.withColumn("length", fn.interval_length(F.col(begin), F.col(end), lo, hi)).where("length is not null")


def null_sentinel(df: DataFrame, columns: list[str], value: float) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(value)) for c in columns})


def tag(df: DataFrame, label: str, column: str = "dataset") -> DataFrame:
    return df.withColumn(column, F.lit(label))


def quarantine_malformed(df: DataFrame, column: str, canonical: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those whose category is a number but not a canonical one: they are shifted."""
    bad = F.coalesce(~F.col(column).isin(canonical) & F.col(column).try_cast("double").isNotNull(), F.lit(False))
    return df.where(~bad), df.where(bad)


def has_sequence(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.trim(F.coalesce(F.col(column), F.lit(""))) != "")


def count_missing(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.coalesce(F.col(column), F.lit("")) == "").alias("n_missing"))
