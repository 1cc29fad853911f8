"""Operators on small frames: nulls, ties, empty strings, single values and zero divisors."""

import math

import pytest
from pyspark.sql import functions as F

from annot.functions import text as fn
from annot.operators import clean, combine, compare, dedup, embed, groups, profile, sequence
from annot.operators import classify as cl
from annot.sources import fasta, reports, tables
from annot.sources.shared import new_path


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_headers_numbers_and_names(spark):
    df = spark.createDataFrame([("1", "x"), ("a", "a"), (None, "y")], "a string, b string")
    assert rows(clean.drop_repeated_headers(df, "a")) == [("1", "x"), (None, "y")]
    assert rows(clean.coerce_numeric(df, ["a"])) == [(1.0, "x"), (None, "a"), (None, "y")]
    names = spark.createDataFrame([("a b/ç-1.x",), ("",), (None,)], "n string")
    assert rows(names.select(fn.safe_name(F.col("n")))) == [("a_b_ç-1.x",), ("unknown",), ("unknown",)]
    assert rows(names.select(fn.safe_name(F.col("n"), True)))[0] == ("a_b__-1.x",)
    header = spark.createDataFrame([(["a", "b", "a", "a", "c", "b"],)], "h array<string>")
    assert header.select(reports.dedupe_header(F.col("h"), {"a": "second"})).head()[0] == ["a", "b", "second", "a_3", "c", "b_2"]
    assert clean.trim_frame(spark.createDataFrame([(" x ",)], "` n ` string")).collect()[0].n == "x"


def test_flags_and_sentinels(spark):
    df = spark.createDataFrame([("ACG", 5, "pseudo,trunc_start:8"), (None, None, None), ("", 0, "IPD:-0.10")], "primary_sequence string, intron_begin int, Note string")
    assert [r[3:] for r in clean.add_flags(df).collect()] == [(3, True, True, True), (0, False, False, False), (0, False, False, False)]
    good, bad = clean.quarantine_malformed(spark.createDataFrame([("Ala",), ("71.2",), ("Foo",), (None,)], "c string"), "c", ["Ala"])
    assert rows(bad) == [("71.2",)] and good.count() == 3
    df = spark.createDataFrame([("a", -999.0), ("a", 1.0), ("b", -999.0)], "k string, v double")
    assert rows(profile.mean_matrix(df, "k", ["v"], -999.0)) == [("a", -499.0), ("b", None)]
    assert rows(profile.mean_matrix(df, "k", ["v"], -999.0, "before_mean")) == [("a", 1.0), ("b", None)]


def test_lineage(spark):
    df = spark.createDataFrame([("d__B;p__P__p__x;c__",), ("d__A",), (None,)], "t string")
    assert rows(tables.split_lineage(df, "t", ["d", "p"], ["d__", "p__"]).select("d", "p")) == [("A", None), ("B", "P__x"), (None, None)]
    assert tables.split_lineage(df, "t", ["d", "p"], ["d__", "p__"], strict=True).where("d = 'B'").collect()[0].p == "P__p__x"


def test_joins(spark):
    iso, main = spark.createDataFrame([("g", "1", "A"), ("g", "2", "B")], "g string, i string, a string"), spark.createDataFrame([("g", "1", "x"), ("h", "2", "y")], "g string, i string, b string")
    structs = spark.createDataFrame([("g", "9", "s")], "g string, i string, s string")
    assert rows(combine.combine_reports(iso, main, structs, ["g", "i"])) == [("g", "1", "A", "x", "")]
    labels = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "k int, l string, o int")
    assert rows(combine.attach_labels(spark.range(1, 3).selectExpr("int(id) k"), labels, "k", "l", "o", "")) == [(1, "b"), (2, "")]
    done = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "y", 0)], "id string, kind string, size int")
    assert rows(combine.pending_inputs(spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), done, "id", "kind", "size", 2)) == [("b",), ("c",)]
    assert rows(combine.reindex(spark.createDataFrame([("b", 3)], "c string, n int"), "c", ["a", "b"])) == [("a", 0, 0), ("b", 1, 3)]


def test_dedup_levels(spark):
    data = [(1, "S", "x", "p"), (2, "S", "x", "q"), (3, "S", "y", "p"), (4, "", "x", None), (5, None, "x", ""), (6, "S", "x", "p")]
    df = spark.createDataFrame(data, "id int, s string, d string, f string")
    kept = {k: rows(v.select("id")) for k, v in dedup.dedup_by_levels(df, "s", ["d", "f"], ["id"]).items()}
    assert kept == {"d": [(1,), (3,), (4,)], "f": [(1,), (2,), (4,)]}
    assert rows(dedup.dedup_summary(df, "s", ["d", "f"]).select("level", "total", "kept")) == [("d", 6, 3), ("f", 6, 3)]
    assert rows(dedup.dedup_progress(df, ["s"], 4, ["id"])) == [(1, 4, 2), (2, 6, 3)]
    once = dedup.dedup_exact(df, "s", ["id"])
    assert rows(once.select("id")) == [(1,)] == rows(dedup.dedup_exact(once, "s", ["id"]).select("id"))


def test_containment(spark):
    seqs = ["ACGTACGTAA", "CGTACG", "GTA", "TTT", "ACGTACGTAA", "", None, "A", "TTTT", "CGTACGX"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string")
    different = {s for s in seqs if s}
    want = sorted(s for s in different if not any(s != b and s in b for b in different))
    for k in (2, 4, 8):
        assert sorted(r.s for r in dedup.dedup_containment(df, "id", "s", k=k).collect()) == want
    texts = ["a b c d e f g h", "x a b c d e f g h y", "b c", "c d e", "zz", "a  b", "x a  b y", "b c d e f g hh"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    want = sorted(s for s in texts if not any(s != b and s in b for b in texts))
    assert sorted(r.s for r in dedup.dedup_containment(df, "id", "s", by="words").collect()) == want


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 2.0), ("b", None)], "k string, v double")
    assert rows(profile.distribution(df, "k")) == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert rows(profile.top_k(df, "k", 1)) == [("a", 2)]
    assert rows(profile.missing_values(df)) == [("k", 1, 25.0), ("v", 1, 25.0)]
    assert rows(profile.extreme_keys(df, "k")) == [("fewest", "b", 1), ("most", "a", 2)]
    d = profile.describe_exact(df, ["v"]).collect()[0]
    assert (d.n, d.mean, d.std, d.p25, d.p75) == (3, 2.0, 1.0, 1.5, 2.5)
    same = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 4).collect()
    assert sum(r.n for r in same) == 2 and min(r.lo for r in same) == 1.5 and len(same) == 4
    many = profile.histogram(spark.range(101).selectExpr("double(id) v"), "v", 10, density=True).collect()
    assert sorted(r.n for r in many) == [10] * 9 + [11] and abs(sum(r.density * 10 for r in many) - 1) < 1e-9
    assert profile.histogram(df.where("v > 9"), "v", 3).count() == 0
    comp = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("h", "y")], "u string, c string")
    assert {r.c: round(r.mean_pct, 6) for r in profile.mean_composition(comp, "u", "c").collect()} == {"x": round(100 / 3, 6), "y": round(200 / 3, 6)}


def test_hexbin_places_points_on_the_nearer_lattice(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 10.0), (0.5, 0.6), (9.9, 9.9)], "x double, y double")
    got = {(r.lattice, r.i, r.j): r.n for r in profile.hexbin(df, "x", "y", 10).collect()}
    want = {}
    for x, y in ((0, 0), (10, 10), (0.5, 0.6), (9.9, 9.9)):
        u, v = x, y / 10 * 5
        a, b = (math.floor(u + 0.5), math.floor(v + 0.5)), (math.floor(u) + 0.5, math.floor(v) + 0.5)
        first = (u - a[0]) ** 2 + 3 * (v - a[1]) ** 2 < (u - b[0]) ** 2 + 3 * (v - b[1]) ** 2
        cell = (1, *a) if first else (2, math.floor(u), math.floor(v))
        want[cell] = want.get(cell, 0) + 1
    assert got == want


def test_groups(spark):
    df = spark.createDataFrame([("g1", "p", "x"), ("g1", "p", "y"), ("g2", "p", "y"), ("g3", "q", "x"), ("g4", None, "x")], "u string, p string, c string")
    assert rows(groups.units_per_group(df, "p", "u")) == [("p", 2), ("q", 1)]
    assert rows(groups.prevalence(df, "u", "p", F.col("c") == "x")) == [("p", 2, 50.0), ("q", 1, 100.0)]
    assert rows(groups.mean_count_matrix(df, "u", "p", "c", 1)) == [("p", "x", 0.5), ("p", "y", 1.0)]
    assert rows(groups.flag_rate(df, F.when(F.col("c") == "x", True), "p", "u")) == [("p", round(100 / 3, 9)), ("q", 100.0)]
    assert rows(groups.composition_by_group(df, "u", "p", "c", ["y"])) == [("p", "x", 100.0), ("q", "x", 100.0)]


def test_compare(spark):
    a, b = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "k string, v int"), spark.createDataFrame([("x", 1), ("z", 4)], "k string, v int")
    assert rows(compare.compare_distribution(a, b, "k").drop("mean_change")) == [("x", 2, 1, -50.0), ("y", 1, 0, -100.0), ("z", 0, 1, None)]
    assert rows(combine.paired_delta(a, b, "k")) == [("x", 2, 1, -1)]
    assert ("n_rows", 3, 2, round(100 / 3, 9)) in rows(compare.compare_overview(a, b, {"n_k": "k"}))


@pytest.mark.parametrize(
    ("seq", "codon", "ss", "place"),
    [
        ("AAACGTAAA", "CGT", ".........", 3), ("AAACGTAAA", "CGT", "(((....((", None), ("CGTAAAAAA", "CGT", ".........", None), ("AACGTCGTA", "CGT", "((.......", 5),
        ("AACGT", "CGT", ".....", 2), ("ACG", "ACG", "...", None), ("AAACGTAAA", "GGG", ".........", None), ("AAACGT", "CGT", ".....)", None),
    ],
)
def test_find_in_loop(spark, seq, codon, ss, place):
    got = sequence.mask_anticodon(spark.createDataFrame([(seq, codon, ss)], "primary_sequence string, Codon string, secondary_structure string")).collect()[0]
    assert got.anticodon_start == place
    assert got.anticodon_masked_sequence == (seq if place is None else seq[:place] + "NNN" + seq[place + 3 :])


def test_one_hot(spark):
    got = sequence.one_hot(spark.createDataFrame([("aUx",), ("",), (None,)], "s string"), "s", 4).collect()
    assert got[0].features == [1.0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    assert got[1].features == [0.0] * 20


def test_metrics_and_vectors(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "t int, p int")
    got = {r["class"]: tuple(r)[1:] for r in cl.per_class_metrics(df, "t", "p").collect()}
    assert got == {0: (1.0, 0.5, 0.667, 2), 1: (0.333, 1.0, 0.5, 1), 2: (0.0, 0.0, 0.0, 1)}
    assert sum(sum(tuple(r)[1:]) for r in cl.confusion_matrix(df, "t", "p", [0, 1, 2, 3]).collect()) == 4
    split = cl.holdout_split(spark.range(11).withColumnRenamed("id", "k"), "k")
    assert split.where("is_test").count() == 3
    pooled = embed.mean_pool(spark.createDataFrame([(1, [[9.0], [1.0], [3.0], [9.0]]), (2, [[1.0], [2.0]])], "i int, t array<array<float>>"), "i", "t")
    assert rows(pooled) == [(1, [2.0]), (2, None)]


def test_fasta(spark):
    path = new_path(spark, "fasta-test")
    spark.createDataFrame([("before\n>a b > c\nAC\nGT\n>d\n\nT\n>e\n",)], "v string").coalesce(1).write.text(path)
    assert rows(fasta.read_fasta(spark, path)) == [("a b > c", "ACGT"), ("d", "T"), ("e", "")]


def test_report_readers(spark):
    path = new_path(spark, "reports-test")
    text = {
        "g.isomodels.out": "\nid\tAnticodon_predicted_isotype\tAla\tArg\nc.trna1\tAla\t5.0\t-999\nc.trna1   Arg   6.0\nlong\tAla\t1\t2\t3\n",
        "g.trnascan.out": "Sequence\nName\ttRNA #\tBegin\tEnd\tType\tCodon\tBegin\tEnd\tScore\tCM\tScore\tNote\n----\nc\t1\t5\t9\tAla\tTGC\t0\t0\t50.1\tAla\t70.0\tpseudo\n\nshort\t2\n",
        "g.struct.out": "c.trna1 (5-9)\tLength: 5 bp\nType: Ala\n  *\nSeq: acgTu\nStr: >..<.\n\nc.trna2 (5-9)\tLength: 5 bp\nStr: .....\n\nc.trna3 (1-2)\tLength: 2 bp\nSeq: ac\n",
        "tiny.trnascan.out": "a\nb\n",
    }
    spark.createDataFrame(list(text.items()), "name string, v string").write.partitionBy("name").text(path)
    iso = reports.read_isomodels(spark, path, scores=["Ala", "Arg"])
    assert rows(iso) == [("g", "c.trna1", "Arg", "6.0", ""), ("g", "long", "Ala", "1", "2")]
    scan = {r.tRNAscanID: r for r in reports.read_scan_report(spark, path).collect()}
    assert scan["c.trna1"].conf_score == "70.0" and scan["c.trna1"].Note == "pseudo" and scan["short.trna2"].CM == "" and len(scan) == 2
    assert rows(reports.read_structures(spark, path)) == [("g", "c.trna1", "ACGTU", ">..<."), ("g", "c.trna2", "", ".....")]
    assert rows(reports.file_manifest(spark, path).select("genome", "complete")) == [("g", True), ("tiny", False)]


def test_csv(spark):
    path = new_path(spark, "csv-test")
    spark.createDataFrame([("a,b",), ("1,2",), ("3",), ("4,5,6",)], "v string").coalesce(1).write.text(path)
    assert rows(tables.read_table_csv(spark, path, ["a", "b"])) == [("1", "2"), ("3", None)]
    with pytest.raises(ValueError, match="missing"):
        tables.require_columns(spark.range(1), ["x"])


def test_summary_levels_are_aggregated_apart(spark):
    """No task makes the pairs of all levels of its rows, which would cost memory for each of them at once."""
    df = spark.range(20).selectExpr("cast(id % 3 as string) AS s", "cast(id % 4 as string) AS d", "cast(id % 5 as string) AS f")
    out = dedup.dedup_summary(df, "s", ["d", "f"])
    assert rows(out.select("level", "total", "kept")) == [("d", 20, 12), ("f", 20, 15)]
    assert rows(dedup.dedup_summary(df.where("false"), "s", ["d", "f"])) == []
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
