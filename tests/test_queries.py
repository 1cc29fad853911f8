"""Every registered query with SQL of its own gives the rows of that SQL on the smallest tables."""

import os

import duckdb
import pytest

from annot.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, list):
        return [plain(v) for v in x]
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sql, name):
    got = registry.queries()[name](spark, SMALL)
    rows = got.collect()
    if name in registry.oracle_sql():
        want = sql.execute(registry.oracle_sql()[name])
        assert table(got.columns, rows) == table([d[0] for d in want.description], want.fetchall())
    else:
        assert rows
