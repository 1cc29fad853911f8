"""Queries of deduplication, joins and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from annot.functions import text as fn
from annot.operators import clean, combine, compare, dedup
from annot.sources.tables import split_lineage

from .base import ITEMS, registry

QUERIES, query = registry()
LEVELS = ["r_name", "n_name", "s_name"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS level, (SELECT count(*) FROM {ITEMS}) AS total, count(*) AS kept, (SELECT count(*) FROM {ITEMS}) - count(*) AS removed, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM {ITEMS}) AS pct_kept FROM (SELECT DISTINCT l_partkey, {c} FROM {ITEMS})" for c in LEVELS))
def dedup_levels_summary(t):
    return dedup.dedup_summary(t.items().select("l_partkey", *LEVELS), "l_partkey", LEVELS)


@query(f"""SELECT l_orderkey, l_linenumber, rr = 1 AS keep_r_name, rn = 1 AS keep_n_name, rs = 1 AS keep_s_name FROM (SELECT l_orderkey, l_linenumber,
 row_number() OVER (PARTITION BY l_partkey, r_name ORDER BY l_orderkey, l_linenumber) AS rr, row_number() OVER (PARTITION BY l_partkey, n_name ORDER BY l_orderkey, l_linenumber) AS rn,
 row_number() OVER (PARTITION BY l_partkey, s_name ORDER BY l_orderkey, l_linenumber) AS rs FROM {ITEMS}) WHERE rs = 1""")
def dedup_level_flags(t):
    rows = t.items().select("l_partkey", *LEVELS, "l_orderkey", "l_linenumber")
    out = dedup.flag_levels(rows, "l_partkey", LEVELS, ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", *[f"keep_{c}" for c in LEVELS])


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, source ORDER BY doc_id) = 1")
def dedup_level_rows(t):
    return dedup.dedup_by_levels(t.documents.select("doc_id", "text", "source"), "text", ["source"], ["doc_id"])["source"].select("doc_id", "source")


@query("""SELECT chunk, max(seen) AS rows_seen, max(kept) AS kept FROM (SELECT ceil(o / 2500.0)::BIGINT AS chunk, o AS seen, (sum(f) OVER (ORDER BY o))::BIGINT AS kept
 FROM (SELECT row_number() OVER (ORDER BY event_id) AS o, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1)::INT AS f FROM events)) GROUP BY chunk""")
def dedup_progress(t):
    return dedup.dedup_progress(t.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], 2500, ["event_id"])


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY text")
def dedup_exact_docs(t):
    return dedup.dedup_exact(t.documents.select("doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query("SELECT n_before, n_after, n_before - n_after AS n_removed, 100.0::DOUBLE * (n_before - n_after) / n_before AS pct_removed FROM (SELECT count(*) AS n_before, count(DISTINCT text) AS n_after FROM documents)")
def removed_stats(t):
    docs = t.documents.select("doc_id", "text")
    return dedup.removed_stats(docs, dedup.dedup_exact(docs, "text", ["doc_id"]))


@query("""WITH d AS (SELECT min(doc_id) AS doc_id, text FROM documents WHERE trim(text) <> '' GROUP BY text)
 SELECT doc_id FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.text <> a.text AND length(b.text) > length(a.text) AND contains(b.text, a.text))""")
def dedup_containment_docs(t):
    return dedup.dedup_containment(t.documents.select("doc_id", "text"), "doc_id", "text", by="words").select("doc_id")


SEQUENCES = """SELECT doc_id * 2 AS id, translate(md5(text || 'a') || md5(text || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq FROM documents
 UNION ALL SELECT doc_id * 2 + 1, substr(translate(md5(text || 'a') || md5(text || 'b'), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1 + (doc_id % 20)::INT, 4 + (doc_id % 37)::INT) FROM documents"""


def sequences(t):
    """Sequences made of the texts' hashes, and parts of them, some of them short."""
    whole = F.translate(F.concat(F.md5(F.concat("text", F.lit("a")).cast("binary")), F.md5(F.concat("text", F.lit("b")).cast("binary"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    rows = t.documents.select("doc_id", whole.alias("seq"))
    part = F.substring("seq", (1 + F.col("doc_id") % 20).cast("int"), (4 + F.col("doc_id") % 37).cast("int"))
    return rows.select((F.col("doc_id") * 2).alias("id"), "seq").unionByName(rows.select((F.col("doc_id") * 2 + 1).alias("id"), part.alias("seq")))


@query(f"""WITH s AS ({SEQUENCES}), d AS (SELECT min(id) AS id, seq FROM s GROUP BY seq)
 SELECT id, seq FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE length(b.seq) > length(a.seq) AND contains(b.seq, a.seq))""")
def dedup_containment_seq(t):
    return dedup.dedup_containment(sequences(t), "id", "seq", k=10)


@query("SELECT item_id AS small, doc_id AS large FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND d.text <> b.text")
def containment_pairs_benchmark(t):
    items, docs = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("seq")), t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("seq"))
    return dedup.containment_pairs(items, docs, by="words")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lang, source)")
def representatives_semi(t):
    reps = t.documents.groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    return combine.filter_to_representatives(t.documents.select("doc_id", "lang"), reps, "doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality + 1 > 0 AND l.toxic + 1 > 0)")
def pending_docs(t):
    outputs = t.labels.select("doc_id", F.explode(F.array(F.struct(F.lit("quality").alias("kind"), (F.col("quality") + 1).alias("size")), F.struct(F.lit("toxic").alias("kind"), (F.col("toxic") + 1).alias("size")))).alias("x")).select("doc_id", "x.*")
    return combine.pending_inputs(t.documents.select("doc_id"), outputs, "doc_id", "kind", "size", 2)


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_wins_turns(t):
    return dedup.last_by_key(t.conversations.select("conv_id", "turn", "role", "text"), ["conv_id"], "turn")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def enrich_left(t):
    return combine.add_taxonomy(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@query("SELECT count(*) AS n_rows, count(quality) AS n_matched, 100.0::DOUBLE * count(quality) / count(*) AS pct_matched, count(DISTINCT CASE WHEN quality IS NULL THEN source END) AS n_unmatched_keys FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def match_stats(t):
    return combine.match_stats(combine.add_taxonomy(t.documents.select("doc_id", "source"), t.labels, "doc_id"), "quality", "source")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def label_default_join(t):
    return combine.attach_labels(t.documents.select("doc_id"), t.labels, "doc_id", "quality", "toxic", -1)


@query("""SELECT d.doc_id, d.lang, l.quality, l.toxic, coalesce(s.source, '') AS source FROM documents d JOIN labels l ON l.doc_id = d.doc_id
 LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 = 0) s ON s.doc_id = d.doc_id""")
def combine_inner_left(t):
    return combine.combine_reports(t.documents.select("doc_id", "lang"), t.labels, t.documents.where("doc_id % 3 = 0").select("doc_id", "source"), ["doc_id"])


def lineage(t):
    rows = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return rows.select("s_suppkey", F.concat(F.lit("d__"), "r_name", F.lit(";p__"), "n_name", F.lit(";s__"), "s_name").alias("taxonomy"))


@query("SELECT s_suppkey, r_name AS domain, n_name AS phylum, s_name AS species FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def lineage_split(t):
    return split_lineage(lineage(t), "taxonomy", ["domain", "phylum", "species"], ["d__", "p__", "s__"]).drop("taxonomy")


@query("""SELECT page_id, regexp_replace(gene, '\\.trna\\d+$', '') AS "ContigID", regexp_replace(replace(genome, '_genomic', ''), '^(RS_|GB_)', '') AS accession
 FROM (SELECT page_id, url || '.trna' || page_id AS gene, CASE WHEN page_id % 2 = 0 THEN 'RS_' ELSE 'GB_' END || page_id || '_genomic' AS genome FROM pages)""")
def derive_ids(t):
    rows = t.pages.select("page_id", F.concat("url", F.lit(".trna"), "page_id").alias("tRNAscanID"), F.concat(F.when(F.col("page_id") % 2 == 0, "RS_").otherwise("GB_"), "page_id", F.lit("_genomic")).alias("GenomeID"))
    return clean.derive_ids(rows).select("page_id", "ContigID", "accession")


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(p_name, '[^A-Za-z0-9_.-]', '_', 'g'), ''), 'unknown') AS name, regexp_replace(p_type, '\\s', '_', 'g') AS kind FROM part")
def safe_names(t):
    return t.part.select("p_partkey", fn.safe_name(F.col("p_name")).alias("name"), fn.no_blanks(F.col("p_type")).alias("kind"))


@query("SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE value::VARCHAR END AS DOUBLE) AS mixed FROM events")
def coerce_numeric(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")).alias("mixed"))
    return clean.coerce_numeric(rows, ["mixed"])


@query("SELECT doc_id, length(text) AS seq_len, coalesce(doc_id % 7 > 0, false) AS has_intron, contains(text, 'pseudo') AS is_pseudo, contains(text, 'the') AS is_the, coalesce(trim(lang), 'Unknown') AS lang FROM documents")
def flags(t):
    rows = t.documents.select("doc_id", "lang", "text", (F.col("doc_id") % 7).alias("i"))
    out = clean.clean_category(clean.add_flags(rows, "text", "i", "text"), "lang")
    return out.select("doc_id", "seq_len", "has_intron", "is_pseudo", F.col("text").contains("the").alias("is_the"), "lang")


@query("SELECT event_id, kind, bad FROM (SELECT event_id, kind, kind NOT IN ('click', 'view') AND try_cast(kind AS DOUBLE) IS NOT NULL AS bad FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN value::VARCHAR ELSE event_type END AS kind FROM events))")
def quarantine_split(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 50 == 0, F.col("value").cast("string")).otherwise(F.col("event_type")).alias("kind"))
    good, bad = clean.quarantine_malformed(rows, "kind", ["click", "view"])
    return good.withColumn("bad", F.lit(False)).unionByName(bad.withColumn("bad", F.lit(True)))


@query("SELECT event_id, event_type, 'all' AS dataset FROM events WHERE event_type IN ('click', 'purchase')")
def trim_tag_prune(t):
    rows = t.events.select(F.col("event_id").alias(" event_id "), F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("event_type "))
    out = clean.tag(clean.trim_frame(rows), "all")
    return out.where(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type", "dataset")


@query("SELECT l_orderkey, l_linenumber, least(greatest(abs(date_diff('day', o_orderdate, l_shipdate)), 0), 60)::DOUBLE AS length FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def interval_length(t):
    rows = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "l_linenumber", F.lit(0).alias("b"), F.datediff("l_shipdate", "o_orderdate").alias("e"))
    return clean.interval_length(rows, "b", "e", 0.0, 60.0).select("l_orderkey", "l_linenumber", F.col("length").cast("double").alias("length"))


def pair(t):
    docs = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    return docs, dedup.dedup_exact(docs, "text", ["doc_id"])


AFTER = "(SELECT * FROM documents WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1)"


@query("""SELECT stat, a::BIGINT AS n_before, b::BIGINT AS n_after, 100.0::DOUBLE * (a - b) / a AS pct_removed FROM (
 SELECT 'n_rows' AS stat, (SELECT count(*) FROM documents) AS a, (SELECT count(*) FROM AFTER) AS b
 UNION ALL SELECT 'n_sources', (SELECT count(DISTINCT source) FROM documents), (SELECT count(DISTINCT source) FROM AFTER)
 UNION ALL SELECT 'n_texts', (SELECT count(DISTINCT text) FROM documents), (SELECT count(DISTINCT text) FROM AFTER))""".replace("AFTER", AFTER))
def compare_overview(t):
    return compare.compare_overview(*pair(t), {"n_sources": "source", "n_texts": "text"})


@query(f"SELECT source AS value, a AS n_before, coalesce(b, 0) AS n_after, 100.0::DOUBLE * (coalesce(b, 0) - a) / a AS pct_change, avg(100.0::DOUBLE * (coalesce(b, 0) - a) / a) OVER () AS mean_change FROM (SELECT source, count(*) AS a FROM documents GROUP BY 1) LEFT JOIN (SELECT source, count(*) AS b FROM {AFTER} GROUP BY 1) USING (source)")
def compare_distribution(t):
    return compare.compare_distribution(*pair(t), "source")


@query(f"""WITH top AS (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 8), x AS (SELECT source AS value, a, b FROM top JOIN (SELECT source, count(*) AS a FROM documents GROUP BY 1) USING (source)
 JOIN (SELECT source, count(*) AS b FROM {AFTER} GROUP BY 1) USING (source)) SELECT value, 100.0::DOUBLE * a / sum(a) OVER () AS pct_before, 100.0::DOUBLE * b / sum(b) OVER () AS pct_after, 100.0::DOUBLE * b / sum(b) OVER () - 100.0::DOUBLE * a / sum(a) OVER () AS shift FROM x""")
def compare_share(t):
    return compare.compare_share(*pair(t), "source", 8)


@query(f"""SELECT dataset, 100.0::DOUBLE * avg((n_chars > 1000)::INT) AS long, 100.0::DOUBLE * avg(contains(text, '@')::INT) AS at FROM (SELECT 'before' AS dataset, * FROM documents UNION ALL SELECT 'after', * FROM {AFTER}) GROUP BY 1""")
def compare_flags(t):
    return compare.compare_flags(*pair(t), {"long": F.col("n_chars") > 1000, "at": F.col("text").contains("@")})


_CHANGES = f"""(SELECT value, pos, coalesce(a, 0) AS n_before, coalesce(b, 0) AS n_after, 100.0::DOUBLE * (coalesce(b, 0) - a) / a AS pct_change FROM (SELECT unnest(['src0', 'src3', 'absent']) AS value, unnest([0, 1, 2]) AS pos)
 LEFT JOIN (SELECT source AS value, count(*) AS a FROM documents GROUP BY 1) USING (value) LEFT JOIN (SELECT source AS value, count(*) AS b FROM {AFTER} GROUP BY 1) USING (value))"""


@query(f"SELECT *, avg(pct_change) OVER () AS mean_change FROM {_CHANGES}")
def compare_distribution_spine(t):
    return compare.compare_distribution(*pair(t), "source", ["src0", "src3", "absent"])


@query(f"""SELECT (SELECT median(a) FROM (SELECT count(*) AS a FROM documents GROUP BY source)) AS median_before, (SELECT median(b) FROM (SELECT count(*) AS b FROM {AFTER} GROUP BY source)) AS median_after,
 (SELECT median(b - a) FROM (SELECT source, count(*) AS a FROM documents GROUP BY 1) JOIN (SELECT source, count(*) AS b FROM {AFTER} GROUP BY 1) USING (source)) AS median_delta""")
def delta_medians(t):
    before, after = pair(t)
    return combine.delta_medians(combine.paired_delta(before, after, "source"), before, after, "source")


@query(f"SELECT source, a AS n_before, b AS n_after, b - a AS delta FROM (SELECT source, count(*) AS a FROM documents GROUP BY 1) JOIN (SELECT source, count(*) AS b FROM {AFTER} GROUP BY 1) USING (source)")
def paired_delta(t):
    return combine.paired_delta(*pair(t), "source")


@query(f"""WITH u AS (SELECT 'before' AS dataset, n_chars::DOUBLE AS v FROM documents UNION ALL SELECT 'after', n_chars FROM {AFTER}), e AS (SELECT dataset, min(v) AS a, max(v) AS b, count(*) AS total FROM u GROUP BY 1),
 c AS (SELECT dataset, least(floor((v - a) / ((b - a) / 30)), 29)::INT AS bin, count(*) AS n FROM u JOIN e USING (dataset) GROUP BY ALL)
 SELECT dataset, g.bin, a + g.bin * ((b - a) / 30) AS lo, a + (g.bin + 1) * ((b - a) / 30) AS hi, coalesce(n, 0) AS n, coalesce(n, 0) / (total * ((b - a) / 30)) AS density
 FROM e CROSS JOIN (SELECT unnest(range(30))::INT AS bin) g LEFT JOIN c ON c.dataset = e.dataset AND c.bin = g.bin""".replace("SELECT dataset, g.bin", "SELECT e.dataset, g.bin"))
def compare_histogram(t):
    return compare.compare_histogram(*pair(t), "n_chars", 30)
