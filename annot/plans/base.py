"""How queries are registered, and tables they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def items(self) -> DataFrame:
        """Line items with their supplier, nation, region and part: the columns that the queries use."""
        place = self.supplier.join(self.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(self.region, F.col("r_regionkey") == F.col("n_regionkey"))
        place = place.select("s_suppkey", "s_name", "n_name", "r_name")
        return self.lineitem.join(place, F.col("s_suppkey") == F.col("l_suppkey")).join(self.part.select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))


ITEMS = """(SELECT * FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
 JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey)"""


def registry():
    """A dict of queries, and a decorator that adds one by its function's name: f(tables) -> DataFrame."""
    found: dict = {}

    def query(sql: str | None = None):
        def add(f):
            found[f.__name__] = (lambda spark, sf_dir: f(Tables(spark, sf_dir)), sql)
            return f

        return add

    return found, query
