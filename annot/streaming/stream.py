"""Incremental deduplication and ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from annot.sources.shared import new_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, on the executors' disks, instead of in their memory."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def file_stream(spark: SparkSession, table: str, path: str) -> DataFrame:
    """A stream of the Parquet files under path that make up the table `table`."""
    schema = spark.read.parquet(f"{path}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(path)


def stream_dedup(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key. Without a watermark the state keeps every key it has seen, as it must."""
    return stream.dropDuplicates(keys)


def run_available(stream: DataFrame, path: str, state: str | None = None) -> StreamingQuery:
    """Writes what is there now to Parquet files under path, and ends.

    state is the folder, shared by driver and executors, of the query's progress and of the keys it has seen (changes of
    RocksDB, from which any executor can go on). A later call with the same folder takes only files that are new, and drops
    keys that an earlier call has written, also in another session; without one, a new folder is taken.
    """
    spark = stream.sparkSession
    with _state_on_disk(spark):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", state or new_path(spark, "stream-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def ingest_batch(batch: DataFrame, number: int, group: str, path: str) -> None:
    """Writes a batch to folders by group in the batch's own folder. Written again, it replaces that folder, so that a batch
    that is run twice leaves the table as it was. Rows are dealt by group, and a large group to several tasks."""
    rows = batch.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("unknown")))
    rows.hint("rebalance", group).write.mode("overwrite").partitionBy(group).parquet(f"{path}/batch={number}")


def stream_ingest(stream: DataFrame, group: str, path: str, state: str | None = None) -> StreamingQuery:
    """Appends each batch to folders by group; null groups are 'unknown'. With the same state folder, a later call goes on."""
    query = stream.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, group, path)).option("checkpointLocation", state or new_path(stream.sparkSession, "ingest-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
