"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The documents of a source are dealt to shards and put in a seeded order; a shard's words, in that order, are cut into
blocks of equal size. Blocks go first to the sources and then, within a source, to its shards, each time to the highest
quotients votes / 1, votes / 3, votes / 5 and so on, until all blocks are given. Every shard then takes its full passes
and, from a seeded start, as many blocks in a row (past the end: from the first on) as its quota leaves. As the order is
random, such a run is a random choice, and most documents are taken whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, seeded, take_rows, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2
BLOCK_WORDS = 32
SHARD_ROWS = 4000
SEED = 11


def sainte_lague(df: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds `won`: the seats of each party when the group's `seats` go to the highest quotients votes / (2 j + 1).

    Rounding each exact quota gives a start that is at most half a seat a party off. What is missing goes to the highest
    next quotients, what is too much is taken from the lowest last ones. A party can gain or lose no more than its share
    of n / 2 seats, and one, so that many quotients a party are compared, about 2.5 n rows for n parties. Ties go to the
    first party, nulls last. A group without votes gets no seats.
    """
    g = Window.partitionBy(*group)
    total = F.sum(votes).over(g)
    share = F.when(total > 0, F.col(votes) / total).otherwise(0.0)
    start = F.floor(share * F.col(seats) + 0.5).cast("long")
    df = df.withColumn("_share", share).withColumn("_start", start).withColumn("_open", F.when(total > 0, F.col(seats) - F.sum(start).over(g)).otherwise(0)).withColumn("_n", F.count(F.lit(1)).over(g))
    most = (F.ceil(F.col("_share") * F.col("_n") / 2) + 1).cast("int")
    steps = F.when(F.col("_open") > 0, most).when(F.col("_open") < 0, F.least(most, F.col("_start").cast("int"))).otherwise(0)
    df = df.withColumn("_step", F.explode_outer(F.when(steps > 0, F.sequence(F.lit(1), steps))))
    sign = F.signum("_open").cast("int")
    odd = F.when(F.col("_open") > 0, 2 * (F.col("_start") + F.col("_step")) - 1).otherwise(2 * (F.col("_start") - F.col("_step")) + 1)
    quotient = F.col(votes) / odd
    won = F.col("_open") > 0
    order = [F.col("_step").isNull(), F.when(won, -quotient).otherwise(quotient), F.when(won, F.col(party)).asc_nulls_last(), F.when(~won, F.col(party)).desc_nulls_first(), "_step"]
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    taken = (F.col("_step").isNotNull() & (place <= F.abs("_open"))).cast("int")
    keep = [c for c in df.columns if not c.startswith("_")]
    moved = df.withColumn("_taken", taken * sign).groupBy(*keep, "_start").agg(F.sum("_taken").alias("_moved"))
    return moved.withColumn("won", F.col("_start") + F.col("_moved")).drop("_start", "_moved")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """Adds weight and target to rows of source and source_size: shares by weight, up to `passes` times a source's size.

    With sources by size for their weight, the words for each unit of weight that the sources not yet full get rise up
    to the first source that isn't filled, and fall from there; the largest value is the solution.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(number - 1, F.lit(len(weights))) + 1))
    whole = Window.partitionBy()
    full = F.col("source_size") * passes
    before = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum(full).over(before), F.lit(0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    return weighed.withColumn("_level", level).withColumn("target", F.least(full.cast("double"), F.max("_level").over(whole) * F.col("weight"))).drop("_level")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, weights=WEIGHTS, share: float = SHARE, passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, h (a hash of the text), size, source_size, target, taken, for each row of df.

    Null texts have size 0 and are taken 0 times; a null source is a source of its own, the last. Rows with equal ids
    are ordered by size; where that is equal too they may swap, which leaves the result the same. Extra columns are
    ignored. An empty table gives an empty table.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    docs = written(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(source).alias("source"), size.alias("size"), seeded(F.lit(seed), F.col(doc_id)).alias("at")), "mix-sizes")
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sources = written(source_targets(sizes, weights, share, passes).withColumn("n_shards", F.ceil(F.col("rows") / shard_rows)), "mix-sources")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = docs.join(sources, same(docs, sources)).select("doc_id", "h", docs["source"], "size", "at", "source_size", "target", F.pmod(F.col("at"), F.col("n_shards")).alias("shard"))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).withColumn("blocks", F.ceil(F.col("shard_size") / block_words))
    shards = written(shards, "mix-shards")
    held = shards.groupBy("source").agg(F.sum("blocks").alias("blocks"))
    whole = Window.partitionBy("all")
    asked = sources.join(held, same(sources, held)).select(sources["source"], "target", "blocks", F.lit(0).alias("all")).withColumn("seats", F.round(F.sum("target").over(whole) / block_words).cast("long"))
    quota = F.least(F.col("won"), F.col("blocks") * passes)
    given = sainte_lague(asked, ["all"], "source", "target", "seats")
    given = given.select("source", F.when(F.col("blocks") > 0, F.floor(quota / F.col("blocks"))).otherwise(0).alias("full"), F.when(F.col("blocks") > 0, quota % F.col("blocks")).otherwise(0).alias("rest"))
    parts = shards.join(given, same(shards, given)).select(shards["source"], "shard", "shard_size", "blocks", "full", "rest")
    parts = sainte_lague(parts, ["source"], "shard", "blocks", "rest")
    begin = F.when(F.col("blocks") > 0, F.pmod(seeded(F.lit(seed), F.col("source"), F.col("shard")), F.col("blocks"))).otherwise(0)
    end = F.col("begin") + F.col("won")
    parts = parts.withColumn("begin", begin).select(
        F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), "full",
        (F.col("begin") * block_words).alias("lo"), F.least(end * block_words, F.col("shard_size")).alias("hi"),
        F.greatest((end - F.col("blocks")) * block_words, F.lit(0)).alias("wrap"),
    )
    before = Window.partitionBy("source", "shard").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    stop = F.col("start") + F.col("size")
    overlap = F.greatest(F.least(stop, F.col("hi")) - F.greatest(F.col("start"), F.col("lo")), F.lit(0)) + F.greatest(F.least(stop, F.col("wrap")) - F.col("start"), F.lit(0))
    out = placed.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    return out.select("doc_id", "h", "size", "source_size", "target", (F.col("full") * F.col("size") + overlap).cast("long").alias("taken"))


def mixed_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """Each row of df as often as is nearest to the words that the mix takes of it; texts without words go."""
    found = mix(df, doc_id, text, source, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    keys = found.groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")).alias("_k"), F.col("h").alias("_h")).agg(F.count(F.lit(1)).alias("n"), F.sum(times).alias("times"))
    return take_rows(df, written(keys.where("times > 0"), "mix-times"), doc_id, text)


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("h")


def _md5(expr: str) -> str:
    return f"('0x' || substr(md5({expr}), 1, 15))::BIGINT"


def _won(table: str, group: str, party: str, votes: str, seats: str) -> str:
    """Highest quotients, all of them listed: slower and plainer than sainte_lague."""
    return f"""
  (SELECT t.*, coalesce(w.won, 0) AS won FROM {table} t LEFT JOIN (
     SELECT grp, par, count(*) AS won FROM (
       SELECT {group} AS grp, {party} AS par, {seats} AS seats,
              row_number() OVER (PARTITION BY {group} ORDER BY {votes} / (2 * j + 1)::DOUBLE DESC, {party}, j) AS place
       FROM (SELECT *, unnest(range(0, least({seats}, ceil({votes} * {seats} / nullif(sum({votes}) OVER (PARTITION BY {group}), 0))::BIGINT + count(*) OVER (PARTITION BY {group}) + 1)::BIGINT)) AS j FROM {table} WHERE {votes} > 0))
     WHERE place <= seats GROUP BY grp, par) w ON t.{group} IS NOT DISTINCT FROM w.grp AND t.{party} IS NOT DISTINCT FROM w.par)"""


ORACLE = f"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         {_md5(f"'{SEED}|' || coalesce(doc_id::VARCHAR, '~')")} AS at_ FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, ceil(count(*) / {SHARD_ROWS}.0)::BIGINT AS n_shards,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size * 2) OVER b, 0)::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM sizes WINDOW b AS (ORDER BY source_size * 2 / weight::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sources AS (SELECT source, source_size, n_shards, least(source_size * 2::DOUBLE, max(level) OVER () * weight) AS target FROM levels),
dealt AS (SELECT d.*, s.source_size, s.target, d.at_ % s.n_shards AS shard FROM docs d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
shards AS (SELECT source, shard, sum(size)::BIGINT AS shard_size, ceil(sum(size) / {BLOCK_WORDS}.0)::BIGINT AS blocks FROM dealt GROUP BY source, shard),
asked AS (
  SELECT s.source, 0 AS all_, s.target, h.blocks, round(sum(s.target) OVER () / {BLOCK_WORDS})::BIGINT AS seats
  FROM sources s JOIN (SELECT source, sum(blocks)::BIGINT AS blocks FROM shards GROUP BY source) h ON s.source IS NOT DISTINCT FROM h.source),
given AS (SELECT source, coalesce(least(won, blocks * 2) // nullif(blocks, 0), 0) AS full_, coalesce(least(won, blocks * 2) % nullif(blocks, 0), 0) AS rest FROM {_won("asked", "all_", "source", "target", "seats")}),
parts AS (SELECT h.*, g.full_, g.rest FROM shards h JOIN given g ON h.source IS NOT DISTINCT FROM g.source),
runs AS (
  SELECT *, CASE WHEN blocks > 0 THEN {_md5(f"'{SEED}|' || coalesce(source, '~') || '|' || shard::VARCHAR")} % blocks ELSE 0 END AS begin_
  FROM {_won("parts", "source", "shard", "blocks", "rest")}),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY at_, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM dealt)
SELECT p.doc_id, p.size, p.source_size, p.target,
       (r.full_ * p.size
        + greatest(least(p.start + p.size, (r.begin_ + r.won) * {BLOCK_WORDS}, r.shard_size) - greatest(p.start, r.begin_ * {BLOCK_WORDS}), 0)
        + greatest(least(p.start + p.size, greatest((r.begin_ + r.won - r.blocks) * {BLOCK_WORDS}, 0)) - p.start, 0))::BIGINT AS taken
FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard
"""
