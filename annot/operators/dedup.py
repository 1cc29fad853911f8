"""Deduplication: at each level of a hierarchy, exact, by containment, and by key."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annot.operators import anchors
from annot.operators.clean import has_sequence
from annot.operators.quantiles import beside
from annot.sources.shared import written

#: Seeds of a text of which the rarest is joined, and letters or words of a part of a long text.
SEEDS, PART = 4, 256
#: One of so many seeds of words, by its hash, is joined for texts that have such.
SPARSE = 8


def last_by_key(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """Of the rows with a key, that with the largest ordinal. Rows of a key meet in a partial aggregation first."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("_row"))
    return best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*[F.col(f"`{c}`") for c in df.columns])


def flag_levels(df: DataFrame, seq: str, levels: list[str], order_by: list[str]) -> DataFrame:
    """The first row of each sequence and combination of levels, with keep_<level>: whether it is the first of (sequence, level).

    Null and '' are one key. Only these rows can be kept at any level: the others share theirs with an earlier row. They
    are found with a partial aggregation, so that a sequence or a taxon with a third of all rows isn't sent to one task;
    the windows over them need one more exchange, by sequence, for all levels.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = {f"_k{i}": blank(c) for i, c in enumerate([seq, *levels])}
    order = F.struct(*order_by)
    first = df.withColumns(keys).groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_row"))
    rows = first.select(*keys, "_row").repartition("_k0")
    at = [F.col(f"_row.`{c}`") for c in order_by]
    flags = {f"keep_{level}": F.row_number().over(Window.partitionBy("_k0", f"_k{i + 1}").orderBy(*at)) == 1 for i, level in enumerate(levels)}
    return rows.withColumns(flags).select("_row.*", *flags)


def dedup_by_levels(df: DataFrame, seq: str, levels: list[str], order_by: list[str]) -> dict[str, DataFrame]:
    """For each level the first row, in the given order, of each (sequence, taxon)."""
    flagged = flag_levels(df, seq, levels, order_by)
    drop = [f"keep_{x}" for x in levels]
    return {x: flagged.where(f"keep_{x}").drop(*drop) for x in levels}


def dedup_summary(df: DataFrame, seq: str, levels: list[str]) -> DataFrame:
    """level, total, kept, removed, pct_kept. Kept rows are the distinct (sequence, level) pairs; null and '' are one.

    Each level has its own aggregation of df, so that no task holds the pairs of two levels, or those and what they come of.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pairs = {c: df.groupBy(blank(seq).alias("s"), blank(c).alias("x")).agg(F.count(F.lit(1)).alias("n")) for c in levels}
    kept = reduce(DataFrame.unionByName, [x.groupBy(F.lit(c).alias("level")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kept")) for c, x in pairs.items()])
    return kept.select("level", "total", "kept", (F.col("total") - F.col("kept")).alias("removed"), (100.0 * F.col("kept") / F.col("total")).alias("pct_kept"))


def with_ordinal(df: DataFrame, order_by: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the 1-based place of each row in the given order: places within sorted partitions, and where these begin."""
    rows = written(df.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row a partition
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return rows.withColumn("_p", part).join(starts, "_p").withColumn(name, F.col("_start") + F.col("_at") - F.shiftleft(F.col("_p"), 33) + 1).drop("_at", "_p", "_start")


def dedup_progress(df: DataFrame, keys: list[str], chunk: int, order_by: list[str]) -> DataFrame:
    """chunk, rows_seen and kept: rows kept so far after each chunk of rows in the given order."""
    placed = with_ordinal(df, order_by)
    part = F.ceil(F.col("ordinal") / chunk).alias("chunk")
    chunks = placed.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    first = placed.groupBy(*keys).agg(F.min("ordinal").alias("ordinal")).groupBy(part).agg(F.count(F.lit(1)).alias("new"))
    so_far = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.join(first, "chunk", "left").select("chunk", F.sum("n").over(so_far).alias("rows_seen"), F.sum(F.coalesce("new", F.lit(0))).over(so_far).alias("kept"))


def dedup_exact(df: DataFrame, seq: str, order_by: list[str]) -> DataFrame:
    """One row, the first, for each sequence that isn't blank."""
    rows, rest = has_sequence(df, seq), [c for c in df.columns if c != seq]
    if rest == order_by[:1]:  # a hash aggregation, without a sort of the sequences
        return rows.groupBy(seq).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)
    first = rows.groupBy(seq).agg(F.min_by(F.struct(*df.columns), F.struct(*order_by)).alias("_row"))
    return first.select("_row.*")


def removed_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    a, b = before.agg(F.count(F.lit(1)).alias("n_before")), after.agg(F.count(F.lit(1)).alias("n_after"))
    return beside(a, b, []).select("n_before", "n_after", (F.col("n_before") - F.col("n_after")).alias("n_removed"), (100.0 * (F.col("n_before") - F.col("n_after")) / F.col("n_before")).alias("pct_removed"))


def _spread(size: Column, many: int = SEEDS) -> Column:
    """Up to `many` places from 0 on below size, evenly spread."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.floor(i * size / many).cast("int")))


def _aligned(short: DataFrame, long: DataFrame, kinds: list[int]) -> DataFrame:
    """id, large, start: places of long texts where a short one can lie, by the one of its seeds that they hold least often.

    short and long have id, seq and n, its length; `kind` letters of a short text make a seed. All seeds of long texts are
    exploded once, by parts, as a place far into a text is slow to reach; only those that a short text asks for are kept,
    with their places, and counted.
    """
    def seed(of: str, i: Column) -> Column:
        return F.xxhash64("kind", F.substring(of, i + 1, F.col("kind"))).alias("seed")

    places = short.select("id", "kind", F.col("n").alias("size"), "seq", _spread(F.col("n") - F.col("kind") + 1).alias("places"))
    asked = places.select("id", "kind", "size", "seq", F.size("places").alias("all"), F.explode("places").alias("off")).select("id", "size", "all", "off", seed("seq", F.col("off")))
    parts = long.where("n > 0").select(F.col("id").alias("large"), F.col("n").alias("room"), "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PART))).alias("from"))
    parts = parts.select("large", "room", "from", F.substring("seq", F.col("from") + 1, F.lit(PART + max(kinds) - 1)).alias("part"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    last = F.least(F.lit(PART - 1), F.col("room") - F.col("kind") - F.col("from"))
    pieces = parts.where(last >= 0).select("large", "room", "from", "part", "kind", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    pieces = pieces.select("large", "room", (F.col("from") + F.col("i")).alias("at"), seed("part", F.col("i")))
    hits = written(pieces.join(asked.select("seed"), "seed", "left_semi"), "hits")
    counts = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    best = asked.join(counts, "seed").groupBy("id", "size", "all").agg(F.min(F.struct("n", "seed", "off")).alias("x"), F.count(F.lit(1)).alias("found"))
    best = best.where("found = all").select("id", "size", "x.seed", "x.off")  # a text that holds it holds all its seeds
    start = F.col("at") - F.col("off")
    return best.join(hits, "seed").where((start >= 0) & (start + F.col("size") <= F.col("room")) & (F.col("size") < F.col("room"))).select("id", "large", start.alias("start"))


def _kinds(rows: DataFrame) -> list[int]:
    """The few kinds of seeds that short texts ask for."""
    return sorted(r[0] for r in rows.select("kind").distinct().collect())


def _by_letters(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    rows = short.withColumn("n", F.length("seq")).withColumn("kind", F.least(F.lit(k), F.col("n")))
    return _verified(rows, long.withColumn("n", F.length("seq")))


def _verified(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """id, large: short texts (id, seq, n, kind) that are where their seeds say in longer ones (id, seq, n)."""
    kinds = _kinds(rows)
    if not kinds:
        return rows.select("id", F.col("id").alias("large")).limit(0)
    found = _aligned(rows, whole, kinds)
    found = found.join(rows.select("id", "n", F.sha2(F.col("seq").cast("binary"), 256).alias("digest")), "id")
    here = found.join(whole.select(F.col("id").alias("large"), "seq", F.col("n").alias("room")), "large")
    stretch = F.substring("seq", F.col("start") + 1, F.col("n"))
    return here.where((F.col("n") < F.col("room")) & (F.sha2(stretch.cast("binary"), 256) == F.col("digest"))).select("id", "large")


def _at(w: str | Column, i: Column, kind: int) -> Column:
    """The seed of `kind` words from place i on."""
    return F.xxhash64(F.lit(kind), *[F.get(w, i + j) for j in range(kind)])


def _sparse(w: str, first: Column, last: Column) -> Column:
    """Places from first to last whose five words have a seed that is one of SPARSE, the same ones in every text."""
    return F.when(last >= first, F.filter(F.sequence(first, last), lambda i: _at(w, i, 5) % SPARSE == 0)).otherwise(F.array().cast("array<int>"))


def _by_words(short: DataFrame, long: DataFrame) -> DataFrame:
    """For short texts with words (w, each with the one white space after it) between the first and the last, which may be parts.

    A text that has sparse seeds asks for some of these, and only the sparse seeds of long texts are joined for it. The
    others, short as a rule, ask for seeds at any place: five words, or all their inner words if there are fewer.
    """
    rows = short.select("id", "w", F.size("w").alias("size"), F.length("seq").alias("chars"), F.explode(F.array(_sparse("w", F.lit(1), F.size("w") - 6))).alias("few"))
    kind = F.least(F.lit(5), F.col("size") - 2)
    many = F.when(F.size("few") > 0, F.size("few")).otherwise(F.col("size") - 1 - kind)
    rows = rows.select("id", "w", "size", "chars", "few", kind.alias("kind"), _spread(many).alias("places"))
    asked = rows.select("id", "w", "size", "chars", "few", "kind", F.size("places").alias("all"), F.explode("places").alias("i"))
    asked = asked.withColumn("off", F.when(F.size("few") > 0, F.get("few", F.col("i"))).otherwise(F.col("i") + 1))
    seeds = F.coalesce(*[F.when(F.col("kind") == k, _at("w", F.col("off"), k)) for k in range(1, 6)])
    asked = written(asked.select("id", "size", "chars", "all", "off", F.when(F.size("few") == 0, F.col("kind")).alias("dense"), seeds.alias("seed")), "asked")
    whole = long.select(F.col("id").alias("large"), "w", F.size("w").alias("room"), F.length("seq").alias("letters"))
    at = whole.select("large", "room", "letters", "w", F.explode(_sparse("w", F.lit(0), F.col("room") - 5)).alias("at"))
    hits = at.select("large", "room", "letters", "at", _at("w", F.col("at"), 5).alias("seed")).join(asked.where("dense is null").select("seed").distinct(), "seed", "left_semi")
    kinds = sorted(r[0] for r in asked.where("dense is not null").select("dense").distinct().collect())  # five at most
    if kinds:
        at = whole.select("large", "room", "letters", "w", F.explode(F.sequence(F.lit(0), F.col("room") - 1)).alias("at"))
        at = at.select("large", "room", "letters", "at", F.explode(F.array(*[F.when(F.col("at") + k <= F.col("room"), _at("w", F.col("at"), k)) for k in kinds])).alias("seed"))
        hits = hits.unionByName(at.where("seed is not null").join(asked.where("dense is not null").select("seed").distinct(), "seed", "left_semi").select(*hits.columns))
    hits = written(hits, "hits")
    counts = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("n"))
    best = asked.join(counts, "seed").groupBy("id", "size", "chars", "all").agg(F.min(F.struct("n", "seed", "off")).alias("x"), F.count(F.lit(1)).alias("found"))
    best = best.where("found = all").select("id", "size", "chars", "x.seed", "x.off")  # a text that holds it holds all its seeds
    start = F.col("at") - F.col("off")
    found = best.join(hits, "seed").where((start >= 0) & (start + F.col("size") <= F.col("room")) & (F.col("chars") < F.col("letters"))).select("id", "large", start.alias("start"), "size")
    found = written(found, "found")
    inner = short.select("id", F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last"), F.sha2(F.array_join(F.slice("w", F.lit(2), F.size("w") - 2), "").cast("binary"), 256).alias("digest"))
    here = found.join(long.select(F.col("id").alias("large"), "seq"), "large").select("id", "large", "start", "size", F.explode(F.array(_split("seq"))).alias("w"))
    stretch = F.sha2(F.array_join(F.slice("w", F.col("start") + 2, F.col("size") - 2), "").cast("binary"), 256)
    here = here.select("id", "large", F.get("w", F.col("start")).alias("before"), F.get("w", F.col("start") + F.col("size") - 1).alias("after"), stretch.alias("digest"))
    return here.join(inner, ["id", "digest"]).where(F.endswith("before", "first") & F.startswith("after", "last")).select("id", "large")


def _by_parts(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    """id and large for short texts of one word or two, which may be parts: found among the distinct words of long texts."""
    short = written(short.select("id", "seq", "w"), "few-words")
    places = long.select(F.col("id").alias("large"), "w", F.size("w").alias("room"), F.length("seq").alias("letters"))
    each = places.select("large", "room", F.explode("w").alias("word"))
    words = written(each.groupBy("word").agg(F.max(F.col("room") > 1).alias("more")), "words")
    one = short.where(F.size("w") == 1).select("id", "seq")
    inside = _by_letters(one, words.select(F.col("word").alias("id"), F.col("word").alias("seq")), k).select("id", F.col("large").alias("word"), F.lit(False).alias("same"))
    inside = inside.unionByName(one.join(words.where("more"), F.col("seq") == F.col("word")).select("id", "word", F.lit(True).alias("same")))
    found = each.join(written(inside.distinct(), "inside"), "word").where("not same or room > 1").select("id", "large")
    two = short.where(F.size("w") == 2).select("id", F.length("seq").alias("chars"), F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    two = two.withColumn("kind", F.least(F.length("b"), F.lit(k)))
    kinds = _kinds(two)
    if not kinds:
        return found
    begun = words.select("word", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).where(F.length("word") >= F.col("kind")).withColumn("head", F.substring("word", F.lit(1), F.col("kind")))
    seconds = begun.join(two.withColumn("head", F.substring("b", F.lit(1), F.col("kind"))), ["kind", "head"]).where(F.startswith("word", "b")).select("id", "chars", "a", "word")
    beside_ = places.where("room > 1").select("large", "letters", "w", F.explode(F.sequence(F.lit(1), F.col("room") - 1)).alias("i"))
    beside_ = beside_.select("large", "letters", F.get("w", F.col("i") - 1).alias("before"), F.get("w", F.col("i")).alias("word"))
    hit = beside_.join(written(seconds, "second-words"), "word").where(F.endswith("before", "a") & (F.col("chars") < F.col("letters")))
    return found.unionByName(hit.select("id", "large"))


def _split(text: str) -> Column:
    return F.split(text, r"(?<=\s)")


def _inside_letters(short: DataFrame, long: DataFrame, k: int) -> DataFrame:
    """id, and large, which is null: only that a short text is in a longer one is told, so no places are kept for most.

    Texts of up to `base` letters are held against the distinct parts of longer texts, as they are. Seeds of the others are
    base, 2 base, 4 base ... letters, as long as the text allows. base is k, or what makes seeds of four letters so many as
    all texts have letters: candidates grow with the texts then, and not with their square.
    """
    rows = short.withColumn("n", F.length("seq"))
    whole = long.withColumn("n", F.length("seq"))
    letters, most = whole.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).head()
    base = max(k, math.ceil(math.log(letters + 1, 4)))
    small = rows.where(F.col("n") <= base)
    none = F.lit(None).cast(long.schema["id"].dataType).alias("large")
    found = []
    if kinds := _kinds(small.withColumn("kind", F.col("n"))):
        parts = whole.select("n", "seq", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(PART))).alias("from"))
        parts = parts.select("n", "from", F.substring("seq", F.col("from") + 1, F.lit(PART + max(kinds) - 1)).alias("part"), F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
        last = F.least(F.lit(PART - 1), F.col("n") - F.col("kind") - F.col("from"))
        pieces = parts.where((F.col("kind") < F.col("n")) & (last >= 0)).select("part", "kind", F.explode(F.sequence(F.lit(0), last)).alias("i")).select(F.substring("part", F.col("i") + 1, F.col("kind")).alias("seq"))
        found.append(small.join(pieces.distinct(), "seq", "left_semi").select("id", none))
    sizes = [base << j for j in range(32) if base << j <= max(most, base)]
    large = rows.where(F.col("n") > base).withColumn("kind", F.greatest(*[F.when(F.col("n") >= x, x) for x in sizes], F.lit(base)))
    found.append(_verified(large, whole).select("id", none))
    return reduce(DataFrame.unionByName, found)


def _contained(short: DataFrame, long: DataFrame, k: int, by: str) -> DataFrame:
    """id and large, with repeats."""
    short, long = (d.where(F.length("seq") > 0).select("id", "seq") for d in (short, long))
    if by == "letters":
        return _by_letters(short, long, k)
    words = lambda d: d.select("id", "seq", F.explode(F.array(_split("seq"))).alias("w"))  # noqa: E731  one split a text
    short, long = words(short), words(long)
    found = _by_words(short.where(F.size("w") > 2), long)
    rest = short.where(F.size("w") <= 2)
    return found.unionByName(_by_parts(rest, long, k)) if rest.limit(1).count() else found


def containment_pairs(short: DataFrame, long: DataFrame, k: int = 12, by: str = "letters") -> DataFrame:
    """small, large: ids of texts of `short` that are contained in a different text of `long`. Both have id and seq.

    Seeds instead of a nested loop: of a few seeds of each short text, the one with fewest places in all long texts says
    where it can lie. Only ids, places and hashes move. The SHA-256 of the stretch at a place is held against that of the
    short text where the long text is, so no text is sent for a candidate. Seeds are k letters, or (by='words', for long
    texts) five whole words that have others on both sides, one if there are fewer; texts too short for a seed of this kind
    are one seed as a whole, so none is missed. Empty and null texts are contained in nothing. Joins on seeds and on long
    texts leave it to Spark to split a seed or a text with many rows.
    """
    return _contained(short, long, k, by).select(F.col("id").alias("small"), "large").distinct()


def dedup_containment(df: DataFrame, id_col: str, seq: str, k: int = 12, by: str = "letters") -> DataFrame:
    """One row for each maximal sequence: not blank, first of its copies, and contained in no other sequence.

    With by='words', texts are looked for by the stretches between their anchors, and seeds of words aren't needed.
    """
    rows = dedup_exact(df, seq, [id_col])
    if by == "words":
        rows = written(rows.withColumn("_n", F.monotonically_increasing_id()), "maximal")
        inner = anchors.contained(rows.select(F.col("_n").alias("id"), F.col(seq).alias("seq")))
        return rows.join(inner.withColumnRenamed("id", "_n"), "_n", "left_anti").drop("_n")
    rows = written(rows, "maximal")
    texts = rows.select(F.col(id_col).alias("id"), F.col(seq).alias("seq"))
    inner = _inside_letters(texts, texts, k).select(F.col("id").alias(id_col)).distinct()
    return rows.join(inner, id_col, "left_anti")
