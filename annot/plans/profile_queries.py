"""Queries of table statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from annot.operators import clean, combine, profile

from .base import registry

QUERIES, query = registry()
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DESCRIBE = "count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v)::DOUBLE AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v)::DOUBLE AS max"


def labelled(t):
    return t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")


@query("SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types, 6 AS n_columns FROM events")
def overview(t):
    return profile.overview(t.events, {"n_users": "user_id", "n_types": "event_type"})


@query("""SELECT * FROM (SELECT 'quality' AS column, count(*) - count(quality) AS n_missing, 100.0::DOUBLE * (count(*) - count(quality)) / count(*) AS pct FROM documents LEFT JOIN labels USING (doc_id)
 UNION ALL SELECT 'toxic', count(*) - count(toxic), 100.0::DOUBLE * (count(*) - count(toxic)) / count(*) FROM documents LEFT JOIN labels USING (doc_id)) WHERE n_missing > 0""")
def missing_values(t):
    return profile.missing_values(labelled(t))


@query("SELECT count(*) - count(quality) AS n_missing FROM documents LEFT JOIN labels USING (doc_id)")
def count_missing(t):
    return clean.count_missing(labelled(t).withColumn("q", F.col("quality").cast("string")), "q")


@query(f"SELECT {DESCRIBE} FROM (SELECT count(*) AS v FROM lineitem GROUP BY l_orderkey)")
def count_per_key_describe(t):
    return profile.count_per_key_describe(t.lineitem, "l_orderkey")


@query("""(SELECT 'most' AS which, l_suppkey, count(*) AS n FROM lineitem GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 1) UNION ALL (SELECT 'fewest', l_suppkey, count(*) FROM lineitem GROUP BY 2 ORDER BY 3, 2 LIMIT 1)""")
def extreme_keys(t):
    return profile.extreme_keys(t.lineitem, "l_suppkey")


@query("SELECT event_type AS value, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM events GROUP BY 1")
def distribution(t):
    return profile.distribution(t.events, "event_type")


@query("SELECT coalesce(quality::VARCHAR, 'none') AS value, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def distribution_with_none(t):
    return profile.distribution(labelled(t).withColumn("quality", F.col("quality").cast("string")), "quality", "none")


@query("""SELECT value, n, CASE WHEN value <> 'noise' THEN 100.0::DOUBLE * n / sum(CASE WHEN value <> 'noise' THEN n END) OVER () END AS pct
 FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'noise' END AS value, count(*) AS n FROM events GROUP BY 1)""")
def distribution_canonical(t):
    return profile.distribution_canonical(t.events, "event_type", ["click", "view"])


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_k(t):
    return profile.top_k(t.part, "p_type", 10)


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, {DESCRIBE.replace('v)', c + ')').replace('(v,', '(' + c + ',')} FROM lineitem" for c in NUMBERS))
def describe_exact(t):
    return profile.describe_exact(t.lineitem, NUMBERS)


def three(_=None):
    return {"pseudo": F.col("text").contains("pseudo"), "trunc": F.col("n_chars") < 500, "intron": F.col("text").contains("@")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER ({p}) AS n, 100.0::DOUBLE * count(*) FILTER ({p}) / count(*) AS pct FROM documents" for n, p in (("pseudo", "contains(text, 'pseudo')"), ("trunc", "n_chars < 500"), ("intron", "contains(text, '@')"))))
def quality_flags(t):
    return profile.quality_flags(t.documents, three())


_P, _T, _I = "contains(text, 'of')", "n_chars < 500", "contains(text, '@')"


@query(" UNION ALL ".join(f"SELECT '{n}' AS flag, count(*) FILTER ({p}) AS n, 100.0::DOUBLE * count(*) FILTER ({p}) / count(*) AS pct FROM documents" for n, p in (("pseudo_only", f"{_P} AND NOT {_T}"), ("trunc_only", f"{_T} AND NOT {_P}"), ("pseudo_and_trunc", f"{_P} AND {_T}"), ("intron", _I), ("clean", f"NOT {_P} AND NOT {_T} AND NOT {_I}"))))
def quality_flags_exclusive(t):
    return profile.quality_flags_exclusive(t.documents, F.col("text").contains("of"), F.col("n_chars") < 500, F.col("text").contains("@"))


@query("""SELECT l_returnflag, 100.0::DOUBLE * count(*) FILTER (l_linestatus = 'O') / count(*) AS "O", 100.0::DOUBLE * count(*) FILTER (l_linestatus = 'F') / count(*) AS "F" FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1""")
def crosstab_pct(t):
    return profile.crosstab_pct(t.lineitem, "l_returnflag", "l_linestatus", ["A", "N", "R"], ["O", "F"])


@query("SELECT o_orderpriority, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75 FROM orders GROUP BY 1")
def quantiles_by(t):
    return profile.quantiles_by(t.orders, "o_orderpriority", "o_totalprice")


@query("SELECT l_returnflag, avg(l_quantity) AS l_quantity, avg(nullif(CASE WHEN l_linenumber = 1 THEN -999 ELSE l_tax END, -999)) AS l_tax FROM lineitem GROUP BY 1")
def mean_matrix(t):
    rows = t.lineitem.select("l_returnflag", "l_quantity", F.when(F.col("l_linenumber") == 1, -999.0).otherwise(F.col("l_tax")).alias("l_tax"))
    return profile.mean_matrix(rows, "l_returnflag", ["l_quantity", "l_tax"], -999.0, "before_mean")


@query("SELECT l_returnflag, avg(CASE WHEN l_linenumber = 1 THEN -999 ELSE l_tax END) AS l_tax FROM lineitem GROUP BY 1")
def mean_matrix_after(t):
    rows = t.lineitem.select("l_returnflag", F.when(F.col("l_linenumber") == 1, -999.0).otherwise(F.col("l_tax")).alias("l_tax"))
    return profile.mean_matrix(rows, "l_returnflag", ["l_tax"], -999.0)


@query("SELECT event_id, nullif(value, 0.0) AS value FROM events")
def null_sentinel(t):
    return clean.null_sentinel(t.events.select("event_id", "value"), ["value"], 0.0)


@query("""WITH m AS (SELECT l_returnflag, avg(l_tax) AS "A", avg(l_discount) AS "N", avg(l_tax * 2) AS "R" FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1)
 SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN "A" WHEN 'N' THEN "N" ELSE "R" END AS own, greatest("A", "N", "R") AS best,
 CASE greatest("A", "N", "R") WHEN "A" THEN 'A' WHEN "N" THEN 'N' ELSE 'R' END AS best_column FROM m""")
def own_vs_best(t):
    rows = t.lineitem.where(F.col("l_returnflag").isin("A", "N", "R")).select("l_returnflag", F.col("l_tax").alias("A"), F.col("l_discount").alias("N"), (F.col("l_tax") * 2).alias("R"))
    return profile.own_vs_best(profile.mean_matrix(rows, "l_returnflag", ["A", "N", "R"]), "l_returnflag", ["A", "N", "R"])


@query("""WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY user_id) AS share FROM p)
 SELECT event_type, sum(share) / (SELECT count(DISTINCT user_id) FROM events) AS mean_pct FROM s GROUP BY 1""")
def mean_composition(t):
    return profile.mean_composition(t.events, "user_id", "event_type")


def _histogram(bins: int, density: str) -> str:
    return f"""WITH e AS (SELECT min(value) AS a, max(value) AS b, count(*) AS total FROM events), c AS (SELECT least(floor((value - a) / ((b - a) / {bins})), {bins - 1})::INT AS bin, count(*) AS n FROM events, e GROUP BY 1)
 SELECT g.bin, a + g.bin * ((b - a) / {bins}) AS lo, a + (g.bin + 1) * ((b - a) / {bins}) AS hi, coalesce(n, 0) AS n{density} FROM e, (SELECT unnest(range({bins}))::INT AS bin) g LEFT JOIN c ON c.bin = g.bin"""


@query(_histogram(30, ""))
def histogram_counts(t):
    return profile.histogram(t.events, "value", 30)


@query(_histogram(60, ", coalesce(n, 0) / (total * ((b - a) / 60)) AS density"))
def histogram_density(t):
    return profile.histogram(t.events, "value", 60, density=True)


@query("""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem),
 p AS (SELECT (l_quantity - x0) / (x1 - x0) * 80 AS u, (l_extendedprice - y0) / (y1 - y0) * 46 AS v FROM lineitem, e),
 d AS (SELECT *, (u - floor(u + 0.5)) ** 2 + 3 * (v - floor(v + 0.5)) ** 2 < (u - (floor(u) + 0.5)) ** 2 + 3 * (v - (floor(v) + 0.5)) ** 2 AS first FROM p)
 SELECT CASE WHEN first THEN 1 ELSE 2 END AS lattice, CASE WHEN first THEN floor(u + 0.5) ELSE floor(u) END::BIGINT AS i, CASE WHEN first THEN floor(v + 0.5) ELSE floor(v) END::BIGINT AS j, count(*) AS n FROM d GROUP BY ALL""")
def hexbin(t):
    return profile.hexbin(t.lineitem, "l_quantity", "l_extendedprice", 80)


@query("SELECT event_id, event_type FROM events ORDER BY md5('0|' || event_id), event_id LIMIT 500")
def sample_n(t):
    return profile.sample_n(t.events.select("event_id", "event_type"), 500, "event_id")


SPINE = ["click", "view", "purchase", "absent"]


@query("SELECT s.value, pos, coalesce(n, 0) AS n, coalesce(pct, 0) AS pct FROM (SELECT unnest(['click', 'view', 'purchase', 'absent']) AS value, unnest([0, 1, 2, 3]) AS pos) s LEFT JOIN (SELECT event_type AS value, count(*) AS n, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM events WHERE value > 50 GROUP BY 1) d ON d.value = s.value")
def flagged_distribution(t):
    return combine.reindex(profile.distribution(t.events.where(F.col("value") > 50), "event_type"), "value", SPINE)


_S = ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]
_LONG = lambda section, key, sub, stats: " UNION ALL ".join(f"SELECT '{section}' AS section, {key}::VARCHAR AS key, '{s}' AS stat, {s}::DOUBLE AS value FROM ({sub})" for s in stats)


_E = "(SELECT event_id, user_id, event_type, value, CASE WHEN event_type = 'click' THEN value END AS click, value / 2 AS \"view\" FROM events)"
_SHARE = "100.0::DOUBLE * count(*) / (SELECT count(*) FROM events)"
_FLAG = lambda name, p: f"SELECT '{name}' AS f, count(*) FILTER ({p}) AS n, 100.0::DOUBLE * count(*) FILTER ({p}) / count(*) AS pct FROM events"
_PER = "SELECT user_id, count(*) AS n FROM events GROUP BY 1"
_FLAGS = {"small": "value < 10", "bought": "event_type = 'purchase'", "never": "value < 0"}
_APART = {"pseudo_only": "value < 10 AND event_id % 3 > 0", "trunc_only": "event_id % 3 = 0 AND value >= 10", "pseudo_and_trunc": "value < 10 AND event_id % 3 = 0", "intron": "user_id % 2 = 0", "clean": "value >= 10 AND event_id % 3 > 0 AND user_id % 2 > 0"}
_MEANS = f"""SELECT event_type, avg(click) AS click, avg("view") AS "view" FROM {_E} GROUP BY 1"""


@query(" UNION ALL ".join([
    _LONG("overview", "'all'", "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, 6 AS n_columns FROM events", ["n_rows", "n_users", "n_columns"]),
    _LONG("missing", "'click'", "SELECT count(*) AS n_missing, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM events) AS pct FROM events WHERE event_type <> 'click'", ["n_missing", "pct"]),
    _LONG("rows_per_key", "'user_id'", f"SELECT {DESCRIBE} FROM (SELECT count(*) AS v FROM events GROUP BY user_id)", _S),
    _LONG("extreme_keys", "user_id", f"SELECT user_id, n AS most FROM ({_PER}) ORDER BY n DESC, user_id::VARCHAR LIMIT 1", ["most"]),
    _LONG("extreme_keys", "user_id", f"SELECT user_id, n AS fewest FROM ({_PER}) ORDER BY n, user_id::VARCHAR LIMIT 1", ["fewest"]),
    *[_LONG("numbers", f"'{c}'", f"SELECT {DESCRIBE} FROM (SELECT \"{c}\" AS v FROM {_E})", _S) for c in ("value", "click")],
    _LONG("distribution:event_type", "event_type", f"SELECT event_type, count(*) AS n, {_SHARE} AS pct FROM events GROUP BY 1", ["n", "pct"]),
    _LONG("top:user_id", "user_id", f"SELECT user_id, n FROM ({_PER}) ORDER BY n DESC, user_id::VARCHAR LIMIT 5", ["n"]),
    _LONG("flags", "f", " UNION ALL ".join(_FLAG(*x) for x in _FLAGS.items()), ["n", "pct"]),
    _LONG("flags_exclusive", "f", " UNION ALL ".join(_FLAG(*x) for x in _APART.items()), ["n", "pct"]),
    _LONG("canonical:event_type", "k", "SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'noise' END AS k, count(*) AS n, CASE WHEN k <> 'noise' THEN 100.0::DOUBLE * count(*) / (SELECT count(*) FROM events WHERE event_type IN ('click', 'view')) END AS pct FROM events GROUP BY 1", ["n", "pct"]),
    "SELECT 'crosstab', event_type, (user_id % 3)::VARCHAR, 100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY event_type) FROM events GROUP BY 2, 3",
    _LONG("quantiles", "event_type", "SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM events GROUP BY 1", ["n", "q25", "q50", "q75"]),
    _LONG("matrix", "event_type", _MEANS, ["click"]),
    f"SELECT 'matrix', event_type, 'view', \"view\" FROM ({_MEANS})",
    f"""SELECT 'own_vs_best', event_type || ':' || CASE WHEN click >= "view" THEN 'click' ELSE 'view' END, unnest(['own', 'best']), unnest([CASE event_type WHEN 'click' THEN click WHEN 'view' THEN "view" END, CASE WHEN click >= "view" THEN click ELSE "view" END]) FROM ({_MEANS})""",
    _LONG("composition", "event_type", "WITH p AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY user_id) AS share FROM p) SELECT event_type, sum(share) / (SELECT count(DISTINCT user_id) FROM events) AS mean_pct FROM s GROUP BY 1", ["mean_pct"]),
    _LONG("histogram:value", "bin", _histogram(12, ""), ["lo", "hi", "n"]),
    _LONG("histogram:click", "bin", _histogram(12, "").replace("FROM events", "FROM (SELECT value FROM events WHERE event_type = 'click')").replace("events, e", "(SELECT value FROM events WHERE event_type = 'click') q, e"), ["lo", "hi", "n"]),
]))
def profile_report(t):
    """All sections over one read of events. The crosstab's column, not one of the table's, is the remainder of user_id by 3."""
    e = t.events.select("event_id", "user_id", "event_type", "value", F.when(F.col("event_type") == "click", F.col("value")).alias("click"), (F.col("value") / 2).alias("view"))
    part = F.col("event_id") % 3 == 0
    low = F.col("value") < 10
    return profile.profile_report(
        e, {"n_users": "user_id"}, ["event_type"], ["value", "click"], "user_id", flags={"small": low, "bought": F.col("event_type") == "purchase", "never": F.col("value") < 0}, exclusive=(low, part, F.col("user_id") % 2 == 0),
        canonical={"event_type": ["click", "view"]}, top={"user_id": 5}, shares=("event_type", F.col("user_id") % 3), quantiles=("event_type", "value"), matrix=("event_type", ["click", "view"]), composition=("user_id", "event_type"), bins=12,
    )
