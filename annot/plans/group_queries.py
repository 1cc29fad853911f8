"""Queries of statistics by group: orders are the units, nations and regions the groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from annot.operators import groups

from .base import registry

QUERIES, query = registry()
BASE = """(SELECT o_orderkey, n_name, r_name, l_returnflag, l_quantity, p_type FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 JOIN region ON r_regionkey = n_regionkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""
TOP5 = f"(SELECT n_name FROM {BASE} GROUP BY 1 ORDER BY count(DISTINCT o_orderkey) DESC, n_name LIMIT 5)"


def base(t):
    place = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey")).select("c_custkey", "n_name", "r_name")
    rows = t.orders.select("o_orderkey", "o_custkey").join(place, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.join(t.part.select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey")).select("o_orderkey", "n_name", "r_name", "l_returnflag", "l_quantity", "p_type")


@query(f"SELECT r_name, count(DISTINCT o_orderkey) AS n_units FROM {BASE} GROUP BY 1")
def units_per_group(t):
    return groups.units_per_group(base(t), "r_name", "o_orderkey")


@query(f"SELECT n_name, count(DISTINCT o_orderkey) AS n_units FROM {BASE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_groups(t):
    return groups.top_groups(base(t), "n_name", "o_orderkey", 5)


def _rows_per_unit(group: str, where: str = "true") -> str:
    return f"SELECT {group}, count(*) AS n_units, min(rows) AS min, quantile_cont(rows, 0.25) AS q25, quantile_cont(rows, 0.5) AS q50, quantile_cont(rows, 0.75) AS q75, max(rows) AS max FROM (SELECT {group}, o_orderkey, count(*) AS rows FROM {BASE} WHERE {where} GROUP BY ALL) GROUP BY 1"


@query(_rows_per_unit("r_name"))
def rows_per_unit_by(t):
    return groups.rows_per_unit_by(base(t), "o_orderkey", "r_name")


@query(_rows_per_unit("n_name", f"n_name IN {TOP5}"))
def rows_per_unit_top(t):
    return groups.rows_per_unit_by(base(t), "o_orderkey", "n_name", 5)


@query(_rows_per_unit("r_name", "l_returnflag = 'R'"))
def copies_per_unit(t):
    return groups.rows_per_unit_by(base(t).where("l_returnflag = 'R'"), "o_orderkey", "r_name")


@query(f"""WITH p AS (SELECT n_name, o_orderkey, l_returnflag, count(*) AS n FROM {BASE} WHERE n_name IN {TOP5} AND l_returnflag <> 'A' GROUP BY ALL), s AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY n_name, o_orderkey) AS share FROM p),
 u AS (SELECT n_name, count(DISTINCT o_orderkey) AS units FROM p GROUP BY 1) SELECT n_name, l_returnflag, sum(share) / any_value(units) AS mean_pct FROM s JOIN u USING (n_name) GROUP BY ALL""".replace(TOP5, f"(SELECT n_name FROM {BASE} WHERE l_returnflag <> 'A' GROUP BY 1 ORDER BY count(DISTINCT o_orderkey) DESC, n_name LIMIT 5)"))
def composition_by_group(t):
    return groups.composition_by_group(base(t), "o_orderkey", "n_name", "l_returnflag", ["A"], 5)


@query(f"""SELECT n_name, l_returnflag, count(*) / any_value(units)::DOUBLE AS mean_count FROM {BASE} JOIN (SELECT n_name, count(DISTINCT o_orderkey) AS units FROM {BASE} GROUP BY 1) USING (n_name) WHERE n_name IN {TOP5} GROUP BY ALL""")
def mean_count_matrix(t):
    return groups.mean_count_matrix(base(t), "o_orderkey", "n_name", "l_returnflag", 5)


@query(f"SELECT n_name, any_value(r_name) AS r_name, count(DISTINCT o_orderkey) AS n_units FROM {BASE} GROUP BY 1")
def order_groups(t):
    return groups.order_groups(base(t), "n_name", "r_name", "o_orderkey", "o_orderkey")


@query(f"SELECT n_name, any_value(r_name) AS r_name FROM {BASE} GROUP BY 1")
def group_parent(t):
    return groups.group_parent(base(t), "n_name", "r_name", "o_orderkey")


@query(f"SELECT n_name, count(DISTINCT o_orderkey) AS n_units, 100.0::DOUBLE * count(DISTINCT CASE WHEN l_returnflag = 'R' THEN o_orderkey END) / count(DISTINCT o_orderkey) AS pct FROM {BASE} GROUP BY 1")
def prevalence(t):
    return groups.prevalence(base(t), "o_orderkey", "n_name", F.col("l_returnflag") == "R")


@query(f"SELECT n_name, 100.0::DOUBLE * avg((l_quantity > 25)::INT) AS pct FROM {BASE} WHERE n_name IN {TOP5} GROUP BY 1")
def flag_rate(t):
    return groups.flag_rate(base(t), F.col("l_quantity") > 25, "n_name", "o_orderkey", 5)


_TOP = f"(SELECT p_type FROM {BASE} GROUP BY 1 ORDER BY count(*) DESC, p_type LIMIT 4)"


@query(f"SELECT r_name, p_type, 100.0::DOUBLE * n / sum(n) OVER (PARTITION BY r_name) AS pct FROM (SELECT r_name, p_type, count(*) AS n FROM {BASE} WHERE p_type IN {_TOP} GROUP BY ALL)")
def share_by_group(t):
    return groups.share_by_group(base(t), "p_type", "r_name", 4)


@query(f"SELECT r_name, p_type, 100.0::DOUBLE * count(*) / any_value(total) AS pct FROM {BASE} JOIN (SELECT r_name, count(*) AS total FROM {BASE} GROUP BY 1) USING (r_name) WHERE p_type IN {_TOP} GROUP BY ALL")
def share_by_group_of_all(t):
    return groups.share_by_group(base(t), "p_type", "r_name", 4, "all")
