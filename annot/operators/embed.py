"""Vectors of sequences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, id_col: str, tokens: str) -> DataFrame:
    """id and the mean of its token vectors without the first and the last; null where none is left."""
    inner = F.slice(F.col(tokens), 2, F.greatest(F.size(tokens) - 2, F.lit(0)))
    total = F.aggregate(F.col("_t"), F.transform(F.get("_t", F.lit(0)), lambda x: F.lit(0.0)), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b.cast("double")))
    rows = df.select(id_col, inner.alias("_t"))
    return rows.select(id_col, F.when(F.size("_t") > 0, F.transform(total, lambda x: x / F.size("_t"))).alias("embedding"))


def mean_by_label(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, dim (from 0), mean: of vectors that are spread over rows."""
    return df.select(label, F.posexplode(vector).alias("dim", "v")).groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def embed(df: DataFrame, id_col: str, seq: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """id and the vectors that a function gives for batches of sequences; make() builds it, once a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for batch in batches:
            vectors = model([s or "" for s in batch["seq"]])
            yield pd.DataFrame({id_col: batch[id_col], "embedding": [np.asarray(v, np.float32).tolist() for v in vectors]})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(seq).alias("seq")).mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>")
