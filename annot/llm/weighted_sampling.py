"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

The terms of a text are its runs of five words, their weights the numbers of times they occur. For each of SAMPLES places
a term gets, from hashes of its own, r and c of the gamma distribution (2, 1) and b of the uniform one; with
t = floor(ln(weight) / r + b), the term for which ln(c) - r (t - b + 1) is least is sampled, and (term, t) is the place's
value. Two texts have equal values at a place with a probability that equals the generalised Jaccard similarity of their
weighted terms: the sum of the smaller weights by the sum of the larger ones.

Rows of terms meet in one partial aggregation in the task that made them; what is shuffled is one row of samples a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, written

SAMPLES = 32
WORDS = 5
#: The least of a text's values is distributed exponentially, with the sum of its weights for rate: with a probability of
#: e^-40, 4e-18, it is over FAR_OUT by that sum. Terms that are can't be sampled.
FAR_OUT = 40.0
#: Characters of text that one range of documents holds, about.
RANGE_CHARS = 64_000_000
_LOW = 0xFFFFFFFF


def _uniform(bits: Column, shift: int, width: int) -> Column:
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)) + 0.5) / float(1 << width)


class _Sample:
    """A term's sample at a place: what its value is at least, and a long that orders terms and holds the value."""

    def __init__(self, term: Column, weight: Column, place: Column):
        h = F.xxhash64(term, place)
        g = F.xxhash64(h, place)
        p, q = _uniform(h, 0, 21) * _uniform(h, 21, 21), _uniform(g, 0, 32) * _uniform(g, 32, 32)
        # c e^-r(t-b+1), with c = -ln q and r = -ln p, is at least this by the weight: no logarithm is needed for it.
        self.least = (1.0 - q) * p
        r, b, log_c = -F.log(p), _uniform(h, 42, 21), F.log(-F.log(q))
        t = F.floor(F.log(weight) / r + b)
        self.log_value = log_c - r * (t - b + 1)
        rank = F.floor((self.log_value + 80.0) * float(1 << 24))
        order = F.greatest(F.lit(0), F.least(rank, F.lit((1 << 31) - 2))).cast("long")
        # The order in the upper half; the value, (term, t), in the lower one.
        self.packed = F.shiftleft(order, 32).bitwiseOR(term.bitwiseXOR(t * F.lit(2654435761)).bitwiseAND(F.lit(_LOW)))


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def fingerprints(df: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys, samples (array of 32-bit values) and rows: the number of rows with these keys, which have one text.

    A text without words, null too, has zeros for samples.
    """
    words = df.select(*keys, _words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    last = F.greatest(F.size("_w") - WORDS, F.lit(0))
    at = F.when(F.size("_w") > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get(F.col("_w"), i + k) for k in range(WORDS)]))
    terms = words.select(*keys, F.sort_array(hashed).alias("_s"))
    # In a sorted list a term's weight is where the next one begins less where it begins itself.
    places = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1)).otherwise(F.array().cast("array<int>"))
    begins = F.filter(places, lambda i: (i == 0) | (F.get("_s", i - 1) != F.get("_s", i)))
    terms = terms.withColumn("_at", begins)
    # Terms and weights go into one array first: exploding places would copy both arrays into every row. The outer form, as
    # from a plain one Catalyst infers a filter on the array's size, and builds the array once more for it.
    entries = F.transform("_at", lambda p, k: F.struct(F.get("_s", p).alias("term"), (F.coalesce(F.get("_at", k + 1), F.size("_s")) - p).alias("weight")))
    own = F.array(F.struct(F.lit(0).cast("long").alias("term"), F.lit(0).alias("weight")))
    rows = terms.select(*keys, (FAR_OUT / F.greatest(F.size("_s"), F.lit(1))).alias("_most"), F.log(FAR_OUT / F.greatest(F.size("_s"), F.lit(1))).alias("_log_most"), F.explode_outer(F.concat(own, entries)).alias("_e")).select(*keys, "_most", "_log_most", F.col("_e.term").alias("_term"), F.col("_e.weight").alias("_n"))
    # Terms that can't be sampled at a place are left out there, before logarithms are taken.
    at = F.explode_outer(F.when(F.col("_n") > 0, F.sequence(F.lit(0), F.lit(samples - 1))).otherwise(F.array(F.lit(0))))
    rows = rows.select(*keys, "_most", "_log_most", "_term", "_n", at.alias("_place"))
    sample = _Sample(F.col("_term"), F.col("_n"), F.col("_place"))
    # coalesce: else Catalyst infers that _most isn't null, and works it out on the whole text once more, word by word.
    near = (sample.least <= F.col("_most") * F.col("_n")) & (sample.log_value <= F.col("_log_most"))
    rows = rows.where((F.col("_n") == 0) | F.coalesce(near, F.lit(False)))
    rows = rows.select(*keys, "_place", (F.col("_n") == 0).cast("int").alias("_own"), F.when(F.col("_n") > 0, sample.packed).alias("_s"))
    least = [F.min(F.when(F.col("_place") == k, F.col("_s"))).alias(f"_{k}") for k in range(samples)]
    found = rows.groupBy(*keys).agg(F.sum("_own").alias("rows"), *least)
    return found.select(*keys, F.array(*[F.coalesce(F.col(f"_{k}").bitwiseAND(F.lit(_LOW)), F.lit(0)) for k in range(samples)]).alias("samples"), "rows")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of places with equal values."""
    return sum(((F.get(a, F.lit(k)) == F.get(b, F.lit(k))).cast("int") for k in range(samples)), F.lit(0)) / float(samples)


def as_text(column: Column, samples: int = SAMPLES) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(column, F.lit(k)))), 8, "0") for k in range(samples)])


def _last_not_under(known: Column, n: int, value: Column) -> Column:
    """The place of the last of n values, in descending order, that is not under value; -1 if there is none."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(-1), lambda at, step: F.when((at + step < n) & (F.get(known, at + step) >= value), at + step).otherwise(at))


def _edited(docs: DataFrame, n: int) -> DataFrame:
    """docs (doc_id, h, n_chars, text) with the edited text and the next document's doc_id and h.

    Documents are dealt to n ranges of ids, and each range also gets the first document of the next one, so that one
    shuffle brings every document and the one after it together. Null ids come last; equal ids are ordered by h.
    """
    ids = docs.select("doc_id")
    ranges = ids.repartitionByRange(n, F.col("doc_id").desc()).groupBy(F.spark_partition_id().alias("p")).agg(F.max("doc_id").alias("first")).where("first is not null")
    firsts = sorted((r["first"] for r in ranges.collect()), reverse=True)  # one id for each partition
    if not firsts:
        firsts, bucket, is_first = [None], F.lit(0), F.lit(True)
    else:
        known = F.array(*[F.lit(x) for x in firsts])
        after = _last_not_under(known, len(firsts), F.col("doc_id"))
        bucket = F.when(F.col("doc_id").isNull(), len(firsts) - 1).otherwise(after)
        is_first = F.coalesce(F.col("doc_id") == F.get(known, F.col("bucket")), F.lit(False))
    before = F.pmod(F.col("bucket") + len(firsts) - 1, F.lit(len(firsts)))
    copies = F.when(is_first, F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra")), F.struct(before.alias("b"), F.lit(1).alias("extra")))).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra"))))
    dealt = docs.withColumn("bucket", bucket).withColumn("c", F.explode(copies)).select("doc_id", "h", "n_chars", "text", "c.b", "c.extra")
    order = Window.partitionBy("b").orderBy("extra", F.col("doc_id").desc_nulls_last(), "h")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    near = dealt.select("doc_id", "h", "n_chars", "text", "extra", F.lead("text").over(order).alias("next_text"), F.lead("doc_id").over(order).alias("next_id"), F.lead("h").over(order).alias("next_h"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    return near.where("extra = 0").select("doc_id", "h", "n_chars", "next_id", "next_h", edited.alias("edited"))


def fingerprint_with_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of df.

    Null texts count as empty. Rows with equal ids follow each other in the order of a hash of their texts; rows equal in
    both give equal results, as many as there are. With a single row, it is its own next. Texts without words are alike.
    An empty table gives an empty table; extra columns are ignored.
    """
    whole = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = whole.select("doc_id", F.xxhash64("text").alias("h"), F.char_length("text").cast("long").alias("n_chars"), "text")
    own = written(fingerprints(docs, ["doc_id", "h", "n_chars"], "text", samples), "cws-own")
    chars = own.agg(F.sum(F.col("n_chars") * F.col("rows"))).head()[0] or 0
    own = own.select("doc_id", "h", "samples")
    edited = _edited(docs, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // RANGE_CHARS)).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    edited = fingerprints(edited, ["doc_id", "h", "n_chars", "next_id", "next_h", "edited_sha256"], "edited", samples)
    a, b = own.alias("a"), own.alias("b")
    out = edited.alias("e").join(a, F.col("e.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("e.h") == F.col("a.h"))).join(b, F.col("e.next_id").eqNullSafe(F.col("b.doc_id")) & (F.col("e.next_h") == F.col("b.h")))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("e.rows"))))
    return out.select(
        F.col("e.doc_id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("a.samples"), samples).alias("fingerprint"), as_text(F.col("e.samples"), samples).alias("edited_fingerprint"),
        likeness(F.col("a.samples"), F.col("e.samples"), samples).alias("near_edited"), likeness(F.col("a.samples"), F.col("b.samples"), samples).alias("near_next"),
    )


def op8_weighted_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(documents(spark, sf_dir))
