"""Streams that stop and go on, batches that are run twice, and a group that holds most rows."""

import glob
from collections import Counter

from pyspark.sql import functions as F

from annot.sources.shared import new_path
from annot.streaming import stream

SCHEMA = "id long, g string"


def arrive(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def table(spark, path, *columns):
    return sorted((tuple(r) for r in spark.read.parquet(path).select(*columns).collect()), key=repr)


def test_dedup_goes_on_from_its_state_in_another_session(spark):
    source, out, state = (new_path(spark, n) for n in ("in", "out", "state"))
    stream.run_available(stream.stream_dedup(arrive(spark, [(1, "a"), (1, "a"), (2, None)], source), ["id", "g"]), out, state)
    assert table(spark, out, "id", "g") == [(1, "a"), (2, None)]
    other = spark.newSession()
    stream.run_available(stream.stream_dedup(arrive(other, [(1, "a"), (2, None), (3, "a"), (3, "a")], source), ["id", "g"]), out, state)
    assert table(spark, out, "id", "g") == [(1, "a"), (2, None), (3, "a")]
    query = stream.run_available(stream.stream_dedup(other.readStream.schema(SCHEMA).parquet(source), ["id", "g"]), out, state)
    assert query.exception() is None and len(table(spark, out, "id")) == 3  # nothing new: nothing written
    assert glob.glob(f"{state.removeprefix('file:')}/state/0/*/*.zip") or glob.glob(f"{state.removeprefix('file:')}/state/0/*/*.changelog")


def test_state_provider_is_put_back(spark):
    before = spark.conf.get(stream._PROVIDER, None)
    source, out = new_path(spark, "in"), new_path(spark, "out")
    stream.run_available(stream.stream_dedup(arrive(spark, [(1, "a")], source), ["id"]), out)
    assert spark.conf.get(stream._PROVIDER, None) == before


def test_a_batch_run_twice_leaves_the_table_equal(spark):
    path = new_path(spark, "ingest")
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (3, None)], SCHEMA)
    stream.ingest_batch(batch, 0, "g", path)
    once = table(spark, path, "id", "g", "batch")
    stream.ingest_batch(batch.where("id = 9"), 1, "g", path)
    stream.ingest_batch(batch, 0, "g", path)
    assert table(spark, path, "id", "g", "batch") == once == [(1, "a", 0), (2, "b", 0), (3, "unknown", 0), (3, "unknown", 0)]


def test_a_large_group_is_written_by_several_tasks(spark):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, path = spark.conf.get(size), new_path(spark, "ingest")
    spark.conf.set(size, "64k")
    try:
        rows = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"))
        stream.ingest_batch(rows, 0, "g", path)
    finally:
        spark.conf.set(size, before)
    files = Counter(f.split("/")[-2] for f in glob.glob(f"{path.removeprefix('file:')}/batch=0/*/*.parquet"))
    assert files["g=hot"] > 3 and spark.read.parquet(path).count() == 200_000


def test_ingest_goes_on_with_new_files(spark):
    source, path, state = (new_path(spark, n) for n in ("in", "ingest", "state"))
    stream.stream_ingest(arrive(spark, [(1, "a")], source), "g", path, state)
    stream.stream_ingest(arrive(spark, [(2, "a"), (3, None)], source), "g", path, state)
    assert table(spark, path, "id", "g", "batch") == [(1, "a", 0), (2, "a", 1), (3, "unknown", 1)]
