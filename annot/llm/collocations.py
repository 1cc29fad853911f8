"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word with its next four in lead columns, padded where its piece ends. ROLLUP over
the columns then sums the windows with equal first four, three and two words, which are the counts of all shorter phrases,
so no table of two-, three- or four-word phrases is ever exploded from the texts.

A phrase can't be more frequent than the phrases in it. So a window is padded as well from the word on with which its prefix
has fewer than `least` occurrences: no prefix that reaches beyond can be a candidate, or a part of one. What is frequent is
known to tasks as bits in a table of fixed size for each length: words by their counts, phrases by sums over hashed keys,
which are too large at most, and only where both phrases of one word less are frequent; a wrong bit makes a window longer,
never a count wrong. So rare windows, which are most and take ten times a key's bytes, are hardly ever sent.

Texts are split once, into a table of 64-bit hashes of their words; that no other word has the hash of a frequent one is
checked, and another seed is taken where one has. Only the words of candidates become strings again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, written
from .words import groups

#: Words of the longest phrases, the occurrences that a candidate has at least, and the share (percent) of them that a longer
#: phrase must have to take its place.
LONGEST, LEAST, ABSORB_PCT = 5, 100, 100
TOP = 2000
#: Parts of a language that are ranked by themselves first: a task that ranks a language gets the first TOP of each.
RANK_PARTS = 64
#: Bits, as a power of two, of the tables of frequent words and of frequent phrases of each length: 4 MB each at every size of input.
BITS = 25
#: Bits of a phrase's key within its part: at PART_WORDS a rare phrase has a frequent one's key with a probability of 0.005 at most.
KEY_BITS = 24
#: Phrases that a task gathers before it sends them, and words of the corpus for each part of the keys.
BLOCK_PHRASES, PART_WORDS = 3_000_000, 8_000_000
#: Bytes of hashes that a task looks at at a time.
LOOK_BYTES = 8 << 20
#: Bytes of text whose words a task counts at a time.
SPLIT_BYTES = 4 << 20
#: Words whose hash a Python worker remembers.
MEMO = 300_000
#: What separates pieces becomes a byte that UTF-8 doesn't have.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\rABCDEFGHIJKLMNOPQRSTUVWXYZ", _BREAK * 10 + b"abcdefghijklmnopqrstuvwxyz")
#: Seed of the hashes of languages, far from those of words.
LANG_SEED = 1 << 40
_MIX, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_W = [f"w{i}" for i in range(1, LONGEST + 1)]


class _Hashes(dict):
    """Signed 64-bit hashes of words, none of them 0, which is the end of a piece."""

    def __init__(self, seed: int):
        super().__init__({_BREAK: 0})
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed) or 1
        self[word] = h = h - (1 << 64) if h >> 63 else h
        return h


def _split(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, text) -> for each text the hashes of its words (0 between pieces), and the words of a few texts with counts."""
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes(seed)
        for rows, raws in groups(batches, "text", SPLIT_BYTES):
            counts: dict[str, Counter] = {}
            langs, codes = rows["lang"].to_pylist(), []
            for lang, raw in zip(langs, raws, strict=True):
                words = (raw.translate(_TABLE).replace(_BREAK, b" \xff ") + b" \xff").split()
                counts.setdefault(lang, Counter()).update(words)
                codes.append(np.array(list(map(hashes.__getitem__, words)), np.int64).tobytes())
            for own in counts.values():
                del own[_BREAK]
            words = [w for own in counts.values() for w in own]
            n = len(words)
            yield pa.RecordBatch.from_arrays([
                pa.array([x for lang, own in counts.items() for x in [lang] * len(own)] + langs, pa.string()), pa.array(words + [None] * len(langs), pa.binary()).cast(pa.string()),
                pa.array([c for own in counts.values() for c in own.values()] + [None] * len(langs), pa.int64()), pa.array([None] * n + codes, pa.binary()), pa.array([0] * n + [1] * len(langs), pa.int32()),
            ], names=["lang", "word", "n", "codes", "kind"])
            if len(hashes) > MEMO:
                hashes = _Hashes(seed)

    return split


def _bit(bits: int, key: np.ndarray) -> np.ndarray:
    """The bit of a key in a table of 2^bits."""
    x = key.astype(np.uint64)
    return (((x ^ (x >> np.uint64(29))) * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def _word_keys(lang: str, word: np.ndarray) -> np.ndarray:
    """Languages are hashed by a seed that words never have: else `de` in es and `es` in de would have one key."""
    return word ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), LANG_SEED)).astype(np.int64)


def _keys(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A part, below `parts`, and KEY_BITS bits within it for each phrase: the more parts, the more keys."""
    return ((((hashes >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32)) | (hashes & np.uint64((1 << KEY_BITS) - 1))).astype(np.int64)


def _has(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _table(keys: DataFrame, bits: int) -> np.ndarray:
    """The bits of a table's keys, set in tasks and gathered as at most 2^bits bits."""
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(bits, b["key"].to_numpy()))], names=["slot"])

    set_ = keys.mapInArrow(places, "slot long").groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for bucket, own in set_.collect():
        out[(bucket - 1) << 12 : bucket << 12] = np.frombuffer(own, np.uint8)
    return out


def _hashed(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, word, n) with the word's hash and its key in a language."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = _Hashes(seed)
            h, langs = np.array([hashes[w] for w in b["word"].cast(pa.binary()).to_pylist()], np.int64), np.array(b["lang"].to_pylist(), object)
            key = np.zeros(len(h), np.int64)
            for lang in set(langs.tolist()):
                key[langs == lang] = _word_keys(lang, h[langs == lang])
            yield pa.RecordBatch.from_arrays([b["lang"], b["word"], b["n"], pa.array(h), pa.array(key)], names=["lang", "word", "n", "h", "key"])

    return add


def _clash(words: DataFrame, known, bits: int) -> bool:
    """Whether another word has the key of a frequent one: only words with a frequent word's bit can."""
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(known.value, np.uint8)
        for b in batches:
            keys = b["key"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys[_has(table, _bit(bits, keys))])], names=["key"])

    keys = words.select("key").mapInArrow(likely, "key long").groupBy("key").count()
    return keys.where("count > 1").limit(1).count() > 0


def _reach(lang: str, codes: np.ndarray, tables: list[np.ndarray], bits: int, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, ... words, one more than there are tables: the places of phrases whose parts are frequent, with their keys.

    Phrases of as many words as a table is for are kept if they are frequent themselves.
    """
    own = _word_keys(lang, codes)
    at = np.flatnonzero((codes != 0) & _has(tables[0], _bit(bits, own)))
    hashes = own[at].astype(np.uint64)
    yield at, own[at]
    for size in range(2, len(tables) + 2):
        both = np.flatnonzero(np.diff(at) == 1)
        at, hashes = at[both], (hashes[both] * _NEXT + codes[at[both] + size - 1].astype(np.uint64)) * _MIX
        hashes ^= hashes >> np.uint64(31)
        keys = _keys(hashes, parts)
        if size <= len(tables):
            good = _has(tables[size - 1], _bit(bits, keys))
            at, hashes, keys = at[good], hashes[good], keys[good]
        yield at, keys


def _frequent(texts: DataFrame, known: list, bits: int, least: int, parts: int) -> DataFrame:
    """The keys of phrases, of one word more than the last table is for, that occur `least` times or more, together with other
    phrases of their key.

    A task sends a part's keys as one sorted block of differences, which takes a byte or two a phrase; blocks of a part, of a
    bounded number of words of the corpus, are added up in one group.
    """
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, waiting, n = [np.frombuffer(b.value, np.uint8) for b in known], [], 0

        def block() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            owner, keys = keys >> 32, (keys & 0xFFFFFFFF).astype(np.uint32)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            steps = np.diff(keys, prepend=np.uint32(0))
            steps[first] = keys[first]
            cut = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True))
            packed = lambda x: [_pack(x[a:b]) for a, b in cut]
            return pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array([b - a for a, b in cut], pa.int64()), pa.array(packed(steps), pa.binary()), pa.array(packed(counts.astype(np.uint32)), pa.binary())], names=["part", "size", "steps", "counts"])

        for lang, codes in _each_lang(batches):
            for _, keys in _reach(lang, codes, tables, bits, parts):
                pass  # the last are those that no table is for
            waiting.append(keys)
            n += len(keys)
            if n > BLOCK_PHRASES:
                yield block()
                waiting, n = [], 0
        if n:
            yield block()

    def add(batch: pd.DataFrame) -> pd.DataFrame:
        sums, most = np.zeros(1 << KEY_BITS, np.uint32), 1 << 31
        for steps, counts, size in zip(batch["steps"], batch["counts"], batch["size"], strict=True):
            keys = np.cumsum(_unpack(steps, size), dtype=np.uint32)
            sums[keys] = np.minimum(sums[keys] + _unpack(counts, size), np.uint32(most))
        return pd.DataFrame({"key": (int(batch["part"].iloc[0]) << 32) | np.flatnonzero(sums >= min(least, most))})

    return texts.mapInArrow(blocks, "part long, size long, steps binary, counts binary").groupBy("part").applyInPandas(add, "key long")


def _pack(numbers: np.ndarray) -> bytes:
    """Small numbers of 32 bits: their lowest bytes, then the next, compressed."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def _unpack(raw: bytes, size: int) -> np.ndarray:
    return np.frombuffer(np.frombuffer(pa.decompress(raw, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, -1).T.tobytes(), np.uint32)


def _each_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """The hashes of a number of texts of one language."""
    for rows, raws in groups(batches, "codes", LOOK_BYTES):
        langs: dict[str, list[bytes]] = {}
        for lang, raw in zip(rows["lang"].to_pylist(), raws, strict=True):
            langs.setdefault(lang, []).append(raw)
        for lang, own in langs.items():
            yield lang, np.frombuffer(b"".join(own), np.int64)


def _windows(known: list, bits: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lead columns at each word that begins a frequent pair: padded with 0 from where the piece or what is frequent ends."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(b.value, np.uint8) for b in known]
        for lang, codes in _each_lang(batches):
            places = [at for at, _ in islice(_reach(lang, codes, tables, bits, parts), 1, len(tables))]
            at = places[0]
            columns = [codes[at]] + [np.zeros(len(at), np.int64) for _ in places]
            for k, own in enumerate(places, 1):
                columns[k][np.searchsorted(at, own)] = codes[own + k]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), *map(pa.array, columns)], names=["lang", *_W[: len(tables)]])

    return look


def _wide(x: Column, digits: int) -> Column:
    return x.cast(f"decimal({digits},0)")


def _prepare(df: DataFrame, text: str, lang: str, least: int, bits: int):
    """Words (lang, word, n, h, key) of all texts and the texts as hashes (lang, codes), tables in the shared folder, and the
    bits of the frequent words."""
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    seed = 0
    while True:
        table = written(rows.mapInArrow(_split(seed), "lang string, word string, n long, codes binary, kind int"), "collocation-words")
        counts = table.where("kind = 0").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = written(counts.mapInArrow(_hashed(seed), "lang string, word string, n long, h long, key long"), "collocation-counts")
        known = df.sparkSession.sparkContext.broadcast(_table(words.where(F.col("n") >= least).select("key"), bits).tobytes())
        if not _clash(words, known, bits):
            return words, table.where("kind = 1").select("lang", "codes"), known
        seed += 1


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, absorb_pct: int = ABSORB_PCT, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """lang, phrase, a, l, r, n, score and the number of words of the candidates that no longer phrase takes in.

    Texts are lower-cased (A-Z), pieces end at `[.,;:!?\\x0A-\\x0D]`, words stand between spaces and tabs. All counts are of a
    language; a null language is `und`. a counts a phrase of 2 to `longest` words, l and r the two parts of its lowest-scoring
    cut (ties: the earliest), n all words; score is floor(1000 a n / (l r)), in decimals of 38 digits. A candidate, with
    a >= least, is left out if one that holds it has absorb_pct percent of its occurrences or more.

    Null and empty texts have no words, repeated rows count again, other columns of df aren't read, and an empty table gives
    none. Counts meet in partial aggregations, so a frequent phrase or language isn't sent to one task.
    """
    spark, cols = df.sparkSession, _W[:longest]
    words, texts, known = _prepare(df, text, lang, least, bits)
    frequent = words.where(F.col("n") >= least)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    parts, tables = max(64, (words.agg(F.sum("n")).head()[0] or 0) // PART_WORDS), [known]
    while len(tables) < longest:
        table = _table(_frequent(texts, tables, bits, least, parts), bits)
        tables += [spark.sparkContext.broadcast(table.tobytes())] * (1 if table.any() else longest - len(tables))  # nothing is longer than what is frequent
    counted = texts.mapInArrow(_windows(tables, bits, parts), "lang string, " + ", ".join(f"{c} long" for c in cols)).groupBy("lang", *cols).agg(F.count(F.lit(1)).alias("n"))
    # A longest window that is itself too rare is only of use for the sums of its prefixes: those of one prefix become one row.
    counted = counted.withColumn(cols[-1], F.when(F.col("n") >= least, F.col(cols[-1])).otherwise(F.lit(0)))
    rolled = spark.sql(f"SELECT lang, {', '.join(cols)}, sum(n) AS f, grouping_id() AS g FROM {{counted}} GROUP BY lang, w1, w2, ROLLUP({', '.join(cols[2:])})", counted=counted)
    size = F.lit(longest) - F.log2(F.col("g") + 1).cast("int")  # the last columns of a prefix are rolled up
    phrases = rolled.where(F.col("f") >= least).withColumn("size", size).withColumn("p", F.slice(F.array(*cols), 1, F.col("size"))).where(~F.array_contains("p", F.lit(0)))
    phrases = written(phrases.select("lang", "p", "f", "size"), "collocation-phrases")
    known_parts = phrases.select("lang", "p", "f").unionByName(frequent.select("lang", F.array("h").alias("p"), F.col("n").alias("f")))

    def part(name: str) -> DataFrame:
        return known_parts.select("lang", F.col("p").alias(f"{name}_p"), F.col("f").alias(name))

    cuts = phrases.select("lang", "p", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"l_p": F.slice("p", F.lit(1), F.col("k")), "r_p": F.slice("p", F.col("k") + 1, F.col("size") - F.col("k"))})
    cuts = cuts.join(part("l"), ["lang", "l_p"]).join(part("r"), ["lang", "r_p"]).join(totals, "lang")
    cuts = cuts.withColumn("num", _wide(_wide(F.col("a"), 16) * 1000, 20) * _wide(F.col("total"), 17)).withColumn("den", _wide(F.col("l"), 18) * _wide(F.col("r"), 18)).withColumn("score", F.expr("num div den"))
    scored = cuts.groupBy("lang", "p").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("x"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.slice("p", i, m))))
    held = phrases.where("size > 2").select("lang", F.col("f").alias("longer"), F.explode(inner).alias("p")).groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    left = scored.join(held, ["lang", "p"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorb_pct * F.col("x.a")))
    left = left.select("lang", "p", "x.*")

    spelled = left.select("lang", "p", F.posexplode("p").alias("i", "h")).join(frequent.select("lang", "h", "word"), ["lang", "h"])
    spelled = spelled.groupBy("lang", "p").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("ws"))
    out = left.join(spelled, ["lang", "p"])
    return out.select("lang", F.array_join(F.col("ws.word"), " ").alias("phrase"), "a", "l", "r", "n", "score", F.size("p").cast("long").alias("n_words"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language by score, a and phrase."""
    order, ranked = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], collocations(documents(spark, sf_dir))
    for of in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*of).orderBy(*order)).cast("long")).where(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT unnest(range(1, 6)) AS m),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM ws, sizes WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE m > 1 AND f >= 100),
cuts AS (SELECT lang, m, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:m], ' ') AS rp FROM cand, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, m, unnest(flatten(list_transform(range(2, m), lambda s: list_transform(range(1, m - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase FROM cand),
longer AS (SELECT lang, phrase, max(a) AS f FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.f IS NULL OR 100 * o.f < 100 * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
