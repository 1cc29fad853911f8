import hashlib
import random

import corpus_pipeline
from annot.llm import queries
from annot.llm.common import documents
from annot.sources.shared import new_path

from .cases import crowded, odd_rows, table, words

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = documents(spark, SMALL)
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == columns, name
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0
    rows = docs.collect()
    assert len({r.doc_id for r in rows}) <= seen[3] and all(r.text.strip() for r in rows)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)


def test_registered(spark):
    assert {n.split("_")[0] for n in queries.queries()} == {*(f"op{i}" for i in range(1, 11)), "pipeline"}
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert hashlib.sha256(b"").hexdigest()


def odd_tables(spark, path, rows):
    """documents with a clashing column and labels of a few of them, as files."""
    docs = crowded(table(spark, rows)).drop("label")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(100, 220)] + [(None, 1, 0), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_stages_on_odd_tables(spark):
    """Null ids and texts, repeated rows, long texts, clashing columns: no stage fails, and each returns its own rows."""
    rng = random.Random(4)
    good, bad = [f"good{i}" for i in range(50)], [f"zz{i}" for i in range(50)]
    rows = [*odd_rows(), *[(i, words(rng, 60, good if i % 3 else bad)) for i in range(100, 220)]]
    rows += [rows[20], (500, rows[21][1]), (501, rows[22][1] + " more"), (None, rows[23][1])]
    path = new_path(spark, "pipeline-odd")
    docs = odd_tables(spark, path, rows)
    texts = {t for _, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, path), f"odd-{name}")
        assert out.columns == docs.columns, name
        kept = out.collect()
        assert kept and {r.text for r in kept} <= texts
        if name in ("exact_dedup", "near_dedup"):
            lower = [(r.text or "").lower() for r in kept]
            assert len(set(lower)) == len(lower), name
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sum(r.piece == 0 for r in packed) == docs.count()


def test_an_empty_table_stays_one(spark):
    path = new_path(spark, "pipeline-empty")
    odd_tables(spark, path, [])
    assert corpus_pipeline.run(spark, path).count() == 0
