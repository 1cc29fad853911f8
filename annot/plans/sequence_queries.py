"""Queries of sequences and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from annot.functions import text as fn
from annot.operators import embed, sequence

from .base import registry

QUERIES, query = registry()
_LOOPS = "." * 10 + ">><<" + "." * 4 + ">>.<<" + "." * 6 + "<" * 3
STRUCTURE = (_LOOPS * 4)[:64]
SEQ = f"""(SELECT doc_id, seq, CASE WHEN doc_id % 4 = 0 THEN 'GGG' ELSE substr(seq, 1 + (doc_id % 50)::INT, 3) END AS codon, '{STRUCTURE}' AS ss
 FROM (SELECT doc_id, translate(md5(text || 'a') || md5(text || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents))"""
#: 1-based places where a codon stands in a run of five or more dots with a dot before it.
PLACES = f"""(SELECT doc_id, seq, list_min(list_filter(range(2, 63), lambda p: substr(seq, p::INT, 3) = codon AND substr(ss, (p - 1)::INT, 4) = '....'
 AND ((p > 2 AND substr(ss, (p - 2)::INT, 1) = '.') OR substr(ss, (p + 3)::INT, 1) = '.'))) - 1 AS s FROM {SEQ})"""


def genes(t):
    seq = F.translate(F.concat(F.md5(F.concat("text", F.lit("a")).cast("binary")), F.md5(F.concat("text", F.lit("b")).cast("binary"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = t.documents.select("doc_id", seq.alias("seq"))
    codon = F.when(F.col("doc_id") % 4 == 0, "GGG").otherwise(F.substring("seq", (1 + F.col("doc_id") % 50).cast("int"), F.lit(3)))
    return rows.select("doc_id", "seq", codon.alias("codon"), F.lit(STRUCTURE).alias("ss"))


@query(f"SELECT doc_id, s AS start FROM {PLACES}")
def find_in_loop(t):
    return genes(t).select("doc_id", fn.find_in_loop(F.col("seq"), F.col("codon"), F.col("ss")).alias("start"))


@query(f"SELECT doc_id, s AS anticodon_start, s + 3 AS anticodon_end, CASE WHEN s IS NULL THEN seq ELSE substr(seq, 1, s::INT) || 'NNN' || substr(seq, (s + 4)::INT) END AS anticodon_masked_sequence FROM {PLACES}")
def mask_anticodon(t):
    return sequence.mask_anticodon(genes(t), "seq", "codon", "ss").select("doc_id", "anticodon_start", "anticodon_end", "anticodon_masked_sequence")


@query(f"SELECT doc_id, seq FROM {PLACES} WHERE s IS NULL")
def mask_failures(t):
    return sequence.mask_failures(sequence.mask_anticodon(genes(t), "seq", "codon", "ss")).select("doc_id", "seq")


@query(f"SELECT doc_id, translate(upper(seq), 'U', 'T') AS seq FROM {SEQ}")
def normalize_seq(t):
    return genes(t).select("doc_id", fn.normalize_seq(F.translate(F.lower("seq"), "t", "u")).alias("seq"))


@query(f"""SELECT doc_id, pos, letter FROM (SELECT doc_id, p AS pos, CASE WHEN substr(seq, p::INT, 1) IN ('A', 'C', 'G', 'T') THEN substr(seq, p::INT, 1) ELSE 'N' END AS letter
 FROM (SELECT doc_id, seq, unnest(range(1, 65)) AS p FROM {SEQ}))""")
def one_hot_long(t):
    rows = sequence.one_hot(genes(t), "seq")
    # The outer form: from a plain one Catalyst infers a filter on the array's size, and builds the array for it too.
    ones = rows.select("doc_id", F.posexplode_outer("features").alias("i", "v")).where("v = 1")
    return ones.select("doc_id", (F.floor(F.col("i") / 5) + 1).alias("pos"), F.get(F.array(*[F.lit(b) for b in "ACGTN"]), F.col("i") % 5).alias("letter"))


@query("""SELECT doc_id, p AS pos, CASE WHEN substr(s, p::INT, 1) IN ('A', 'C', 'G', 'T') THEN substr(s, p::INT, 1) ELSE 'N' END AS letter
 FROM (SELECT doc_id, s, unnest(range(1, least(length(s), 80) + 1)) AS p FROM (SELECT doc_id, translate(upper(replace(text, 'ß', 'ss')), 'U', 'T') AS s FROM documents))""")
def one_hot_text(t):
    """Real texts: of any length, cut at 80 letters as the encoder's length asks, with letters that aren't bases.

    SQL engines differ in the upper case of ß.
    """
    rows = sequence.one_hot(t.documents.select("doc_id", F.replace("text", F.lit("ß"), F.lit("ss")).alias("text")), "text", 80)
    ones = rows.select("doc_id", F.posexplode_outer("features").alias("i", "v")).where("v = 1")
    return ones.select("doc_id", (F.floor(F.col("i") / 5) + 1).alias("pos"), F.get(F.array(*[F.lit(b) for b in "ACGTN"]), F.col("i") % 5).alias("letter"))


@query("SELECT label, i AS dim, avg(v::DOUBLE) AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(range(64))::INT AS i FROM embeddings) GROUP BY ALL")
def mean_by_label(t):
    return embed.mean_by_label(t.embeddings, "label", "embedding")


@query("SELECT vec_id, i AS dim, (a + b) / 2 AS mean FROM (SELECT vec_id, unnest(range(32))::INT AS i, unnest(embedding[1:32])::DOUBLE AS a, unnest(embedding[33:64])::DOUBLE AS b FROM embeddings)")
def mean_pool(t):
    halves = [F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)]
    tokens = F.array(halves[1], *halves, halves[0])  # the first and the last are left out
    rows = embed.mean_pool(t.embeddings.select("vec_id", tokens.alias("tokens")), "vec_id", "tokens")
    return rows.select("vec_id", F.posexplode("embedding").alias("dim", "mean"))


def _letters():
    """A stand-in for a model: the length of a text and its counts of four letters."""
    return lambda texts: np.array([[len(x), *(x.count(c) for c in "aeio")] for x in texts], np.float32)


@query("SELECT doc_id, i AS dim, v FROM (SELECT doc_id, unnest(range(5))::INT AS i, unnest([length(text), " + ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "aeio") + "])::DOUBLE AS v FROM documents)")
def embed_udf(t):
    rows = embed.embed(t.documents, "doc_id", "text", _letters)
    return rows.select("doc_id", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
