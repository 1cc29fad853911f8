import os

from annot.plans import registry
from annot.sources import reports
from annot.sources.shared import new_path


def test_reports_hold_all_lines_of_all_suppliers(spark):
    """A supplier with a third of all lines, suppliers over 40 and third and later lines of an order."""
    path = new_path(spark, "reports-small")
    items = [(7 if i % 3 == 0 else i % 60 + 1, i // 5, i % 5 + 1, float(i % 50), "ANR"[i % 3]) for i in range(900)]
    spark.createDataFrame(items, "l_suppkey long, l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(1, 61)], "s_suppkey long").write.parquet(f"{path}/supplier.parquet")
    got = registry.queries()["report_parse"](spark, path).collect()
    want = sorted((f"g{s}", f"c_{o}_{n}.trna1", flag, str(int(q)), "ACGT" + flag if s % 3 else "") for s, o, n, q, flag in items if s % 5)
    assert sorted((r.GenomeID, r.tRNAscanID, r.isotype, r.End, r.primary_sequence) for r in got) == want
    genomes = {r.genome: (r.complete, r.has_struct) for r in registry.queries()["file_manifest"](spark, path).collect()}
    assert genomes == {f"g{s}": (s % 5 > 0, s % 3 > 0) for s, *_ in items}


def test_a_report_in_several_files_and_blocks(spark):
    path = new_path(spark, "reports-blocks")
    texts = {
        "g.isomodels.out": ["", "id\tAnticodon_predicted_isotype\tAla", *(f"c{i}.trna1\tAla\t{i}" for i in range(60)), "c0.trna1\tArg\tlast"],
        "g.trnascan.out": ["x", "Name\ttRNA #\tBegin\tEnd", "--", *(f"c{i}\t1\t{i}\t9" for i in range(60))],
        "g.struct.out": [x for i in range(60) for x in (f"c{i}.trna1 (1-9)\tLength: 9 bp", "Type: Ala", f"Seq: ac{i}", "Str: >.<", "")],
    }
    for name, lines in texts.items():
        os.makedirs(f"{path}/{name}".removeprefix("file:"))
        for k, (lo, hi) in enumerate([(0, 1), (1, 2), (2, 33), (33, None)]):
            with open(f"{path}/{name}/part-{k}.txt".removeprefix("file:"), "w") as f:
                f.write("".join(x + "\r\n" for x in lines[lo:hi]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        iso = {r.tRNAscanID: (r.Anticodon_predicted_isotype, r.Ala) for r in reports.read_isomodels(spark, path, scores=["Ala"]).collect()}
        scan = {r.tRNAscanID: r.Begin for r in reports.read_scan_report(spark, path).collect()}
        struct = {r.tRNAscanID: (r.primary_sequence, r.secondary_structure) for r in reports.read_structures(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert iso == {f"c{i}.trna1": ("Ala", str(i)) for i in range(60)} | {"c0.trna1": ("Arg", "last")}
    assert scan == {f"c{i}.trna1": str(i) for i in range(60)}
    assert struct == {f"c{i}.trna1": (f"AC{i}", ">.<") for i in range(60)}


def test_reports_in_packs(spark, monkeypatch):
    """As many files for many genomes as for few, and the lines of a long report in several records."""
    from annot.plans import source_queries

    monkeypatch.setattr(source_queries, "LINES", 20)
    made = []
    monkeypatch.setattr(source_queries, "new_path", lambda s, name: made.append(new_path(s, name)) or made[-1])
    test_reports_hold_all_lines_of_all_suppliers(spark)
    assert len(made) == 2
    for path in made:
        assert sum(f.startswith("part-") for _, _, names in os.walk(path.removeprefix("file:")) for f in names) <= 3 * 8


def test_packs_cut_anywhere(spark):
    path = new_path(spark, "packs-cut")
    texts = {
        ".isomodels.out": ["", "id\tAnticodon_predicted_isotype\tAla", *(f"c{i}.trna1\tAla\t{i}" for i in range(6)), "c0.trna1\tArg\tlast"],
        ".trnascan.out": ["x", "Name\ttRNA #\tBegin\tEnd", "--", *(f"c{i}\t1\t{i}\t9" for i in range(6))],
        ".struct.out": [x for i in range(6) for x in (f"c{i}.trna1 (1-9)\tLength: 9 bp", "Type: Ala", f"Seq: ac{i}", "Str: >.<", "")],
    }
    rows = [(f"g{n}{kind}", kind, at, "".join(x + "\r\n" for x in lines[at : at + n])[:-1]) for n in (1, 2, 3, 7, 50) for kind, lines in texts.items() for at in range(0, len(lines), n)]
    reports.write_packs(spark.createDataFrame(rows, "name string, kind string, at long, text string"), path)
    iso = {(r.GenomeID, r.tRNAscanID): (r.Anticodon_predicted_isotype, r.Ala) for r in reports.read_isomodels(spark, path, scores=["Ala"], packed=True).collect()}
    scan = {(r.GenomeID, r.tRNAscanID): r.Begin for r in reports.read_scan_report(spark, path, packed=True).collect()}
    struct = {(r.GenomeID, r.tRNAscanID): (r.primary_sequence, r.secondary_structure) for r in reports.read_structures(spark, path, packed=True).collect()}
    every = [(f"g{n}", i) for n in (1, 2, 3, 7, 50) for i in range(6)]
    assert iso == {(g, f"c{i}.trna1"): ("Arg", "last") if i == 0 else ("Ala", str(i)) for g, i in every}
    assert scan == {(g, f"c{i}.trna1"): str(i) for g, i in every}
    assert struct == {(g, f"c{i}.trna1"): (f"AC{i}", ">.<") for g, i in every}


def test_reports_of_a_few_lines_take_one_shuffle(spark):
    """No second exchange and no join with the counts where no report is long, and no functions of array elements."""
    from annot.plans import source_queries
    from annot.plans.base import Tables

    plan = source_queries._genome_records(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "lambda" not in plan
