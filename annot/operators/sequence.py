"""Masking and encoding of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annot.functions import text as fn


def mask_anticodon(df: DataFrame, seq: str = "primary_sequence", codon: str = "Codon", structure: str = "secondary_structure") -> DataFrame:
    """Adds anticodon_start, anticodon_end (0-based, half-open; null if not found) and the sequence with NNN there."""
    start = fn.find_in_loop(fn.normalize_seq(F.col(seq)), fn.normalize_seq(F.col(codon)), F.col(structure))
    out = df.withColumn("anticodon_start", start)
    return out.withColumns({"anticodon_end": F.col("anticodon_start") + 3, "anticodon_masked_sequence": fn.masked(F.col(seq), F.col("anticodon_start"))})


def mask_failures(df: DataFrame) -> DataFrame:
    """Rows of mask_anticodon's result without an anticodon."""
    return df.where("anticodon_start is null")


def one_hot(df: DataFrame, seq: str, max_len: int | None = None, u_to_t: bool = True, output: str = "features") -> DataFrame:
    """Adds the one-hot array; max_len is the longest sequence's length unless it is given."""
    if max_len is None:
        max_len = df.agg(F.max(F.length(seq))).head()[0] or 0
    return df.withColumn(output, fn.one_hot(F.col(seq), max_len, u_to_t))
