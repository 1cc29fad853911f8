"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted, by hash and then by content,
and their places in that order become integer names. Adjacent names are then paired, the distinct pairs sorted and
named alike, and so on until each document has one name. Two documents have the same number of rounds and the same
name if and only if their texts are equal: names stand for contents, never for hashes alone.

Only the distinct blocks of a task are shuffled with their bytes, once; everything else moves as integers. Copies,
however many, collapse before the shuffle; the joins that hand names back have one row a name on one side, so that
Spark can split a hot name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, lower_ascii, take_rows, written

BLOCK_BYTES = 4096


def _default_hash(block):
    return F.xxhash64(block)


def _blocks(text, block_bytes: int):
    raw = text.cast("binary")
    last = F.greatest(F.octet_length(text) - 1, F.lit(0))
    at = F.sequence(F.lit(0), F.floor(last / block_bytes).cast("int"))
    return F.transform(at, lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes)))


def _numbered(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Adds name: the place in the order of `keys`, within a bucket that the hash of `by` picks and that the name holds."""
    buckets = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return df.withColumn("bucket", bucket).withColumn("name", F.shiftleft(F.col("bucket"), 32) + place).drop("bucket")


def text_identities(df: DataFrame, doc_id: str = "doc_id", text: str = "text", normalise=lower_ascii, block_bytes: int = BLOCK_BYTES, block_hash=_default_hash) -> DataFrame:
    """One row a row of df: row_id, doc_id, h (of the text as it is), text_sha256, rounds and name; (rounds, name) is the text's identity.

    Null texts count as empty; an empty text is one empty block. Repeated rows, null ids and extra columns are no
    trouble: rows are told apart by row_id, not by doc_id. An empty table gives an empty table.
    """
    norm = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), normalise(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    cut = norm.withColumn("blocks", _blocks(F.col("norm"), block_bytes))
    rows = written(
        cut.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.transform("blocks", block_hash).alias("hashes")),
        "exact-rows",
    )
    contents = cut.select(F.explode("blocks").alias("block")).select(block_hash(F.col("block")).alias("h"), "block").groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("contents"))
    several = F.size("contents") > 1
    listed = contents.select("h", several.alias("several"), F.posexplode("contents").alias("place", "content"))
    names = written(_numbered(listed.select("h", "several", "place", F.when(F.col("several"), F.col("content")).alias("content")), ["h", "place"], ["h"]), "exact-blocks")

    blocks = rows.select("row_id", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    one = names.where(~F.col("several")).select("h", "name")
    current = blocks.join(one, "h").select("row_id", "n", "pos", "name")
    if names.where("several").limit(1).count():
        # Different blocks with one hash are told apart by their bytes.
        many = names.where("several").select("h", F.col("content").alias("block"), "name")
        again = cut.select("doc_id", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", block_hash(F.col("block"))).join(many, ["h", "block"])
        named = again.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("id"), "text_sha256", "pos", "name").distinct()
        ids = rows.select("row_id", F.size("hashes").alias("n"), F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("id"), "text_sha256")
        current = current.unionByName(ids.join(named, ["id", "text_sha256"]).select("row_id", "n", "pos", "name"))
    current = written(current, "exact-names-0")
    done = current.where("n = 1").select("row_id", F.lit(0).alias("rounds"), "name")
    longest = current.agg(F.max("n")).head()[0] or 1

    rounds = 0
    while longest > 1:
        rounds += 1
        half = F.shiftright("pos", 1)
        side = [F.max(F.when(F.pmod(F.col("pos"), F.lit(2)) == k, F.col("name"))).alias("ab"[k]) for k in (0, 1)]
        pairs = current.where("n > 1").groupBy("row_id", F.floor((F.col("n") + 1) / 2).cast("int").alias("n"), half.alias("pos")).agg(*side).withColumn("b", F.coalesce("b", F.lit(-1)))
        pairs = written(pairs, f"exact-pairs-{rounds}")
        new = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"])
        current = written(pairs.join(new, ["a", "b"]).select("row_id", "n", "pos", "name"), f"exact-names-{rounds}")
        done = done.unionByName(current.where("n = 1").select("row_id", F.lit(rounds).alias("rounds"), "name"))
        longest = (longest + 1) // 2
    return rows.drop("hashes").join(done, "row_id")


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of df; of rows equal in id too, one is kept."""
    found = written(text_identities(df, doc_id, text, **options), "exact-found")
    # Written, so that the join's sides are plain exchanges, of which Spark can split that of a group with many copies.
    groups = written(found.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row_id")).alias("keep")), "exact-groups")
    kept = F.col("row_id") == F.col("keep.row_id")
    return found.join(groups, ["rounds", "name"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "row_id", "h")


def drop_exact_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df without exact copies: of equal texts, the row with the largest id stays.

    Rows equal in id and text are one document, and one of them stays.
    """
    found = exact_groups(df, doc_id, text, **options)
    keys = found.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("_k"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("kept").cast("int")).alias("times"))
    return take_rows(df, written(keys.where("times > 0"), "exact-kept"), doc_id, text)


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("row_id", "h")


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
