"""Text reports of annotation runs: one report of each kind for a genome."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annot.functions.text import split_fields
from annot.operators.dedup import last_by_key
from annot.schema import ISOTYPES, MAIN_COLUMNS, MAIN_RENAMES

ISO_SUFFIX, MAIN_SUFFIX, STRUCT_SUFFIX = ".isomodels.out", ".trnascan.out", ".struct.out"
#: What ends each record of a pack, the ASCII record separator. A record is a report or a part of one: its name, a tab, the
#: number of its first line in the report (from 0; numbers may be left out between records), a line feed, and its lines.
RECORD = "\x1e"


def _stem(path: Column, suffix: str) -> Column:
    """What stands before the suffix in the name of a report, which is a file or a folder with one; null for other files."""
    return F.nullif(F.regexp_extract(path, r"([^/=]*)" + re.escape(suffix) + r"(/[^/]*)?$", 1), F.lit(""))


def write_packs(records: DataFrame, path: str) -> None:
    """Writes records (name, kind, which is the suffix of its name, at, text) as packs: a few files for many reports."""
    value = F.concat("name", F.lit("\t"), F.col("at").cast("string"), F.lit("\n"), "text")
    records.select(F.substring("kind", 2, 1 << 30).alias("kind"), value.alias("value")).write.partitionBy("kind").text(path, lineSep=RECORD)


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, lineSep=RECORD).where("value != ''")
    head = F.substring_index("value", "\n", 1)
    return rows.select("kind", "value", head.alias("head"), F.substring_index(head, "\t", 1).alias("name"), F.col("_metadata.file_path").alias("file"))


def _bodies(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """GenomeID, at and lines of every record of a kind in packs."""
    rows = _records(spark, path).where(F.col("kind") == suffix[1:]).where(_stem(F.col("name"), suffix).isNotNull())
    body = F.regexp_replace(F.expr("substring(value, length(head) + 2)"), r"\r(?=\n|\z)", "")
    return rows.select(_stem(F.col("name"), suffix).alias("GenomeID"), F.substring_index("head", "\t", -1).cast("long").alias("at"), body.alias("body"))


def _packed_lines(spark: SparkSession, path: str, suffix: str, own: Column, head: Column, names: list[str]) -> DataFrame:
    """GenomeID, pos, fields of each line of packs that isn't blank, whether it is its report's first such (header), and `places`, those of the names in the report's header.

    `own` says whether a record (at, lines) holds the header, and `head` what names it has, or may have; other records get
    those of the first one that has. So only parts of long reports are joined, as a whole, and no line is.
    """
    records = _bodies(spark, path, suffix).select("GenomeID", "at", F.explode(F.array(F.split("body", "\n"))).alias("lines"))
    places = F.array(*[F.array_position(head, n).cast("int") for n in names])
    begin = F.coalesce(F.array_position(F.transform("lines", lambda x: F.trim(x) != ""), True), F.lit(0)) - 1 + F.col("at")  # the first line that isn't blank
    heads = records.where(own).groupBy("GenomeID").agg(F.min(F.struct(begin.alias("begin"), places.alias("places"))).alias("head")).select("GenomeID", "head.*")
    first = own & (F.col("at") == 0)
    alone = records.where(first).select("GenomeID", "at", "lines", begin.alias("begin"), F.explode(F.array(places)).alias("places"))
    later = records.where(~first).join(heads, "GenomeID").select("GenomeID", "at", "lines", "begin", "places")
    rows = alone.unionByName(later).select("GenomeID", "at", "begin", "places", F.posexplode("lines").alias("i", "line")).where(F.trim("line") != "")
    pos = F.col("at") + F.col("i")
    return rows.select("GenomeID", pos.alias("pos"), (pos == F.col("begin")).alias("header"), "places", F.explode(F.array(split_fields(F.col("line")))).alias("fields"))


def file_manifest(spark: SparkSession, path: str, iso_suffix: str = ISO_SUFFIX, main_suffix: str = MAIN_SUFFIX, struct_suffix: str = STRUCT_SUFFIX, packed: bool = False) -> DataFrame:
    """genome and the paths of its reports (iso, main, struct), null where there is none; complete: iso and main are there.

    The path of a report in packs is that of a pack that holds it, '#' and its name.
    """
    if packed:
        files = _records(spark, path).select(F.concat("file", F.lit("#"), "name").alias("whole"), F.concat(F.lit("/"), "name").alias("path"))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("path").alias("whole"))
    kinds = {"iso": iso_suffix, "main": main_suffix, "struct": struct_suffix}
    stems = F.coalesce(*[_stem(F.col("path"), s) for s in kinds.values()])
    rows = files.select(stems.alias("genome"), *[F.when(_stem(F.col("path"), s).isNotNull(), F.col("whole")).alias(k) for k, s in kinds.items()]).where("genome is not null")
    out = rows.groupBy("genome").agg(*[F.max(k).alias(k) for k in kinds])
    return out.withColumn("complete", F.col("iso").isNotNull() & F.col("main").isNotNull())


def _lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """GenomeID, part, pos and line of every report, a file or a folder whose files follow each other by their names.

    part counts a report's blocks of files and pos its lines, so that a long report is spread over tasks by its blocks.
    """
    lines = spark.read.text(f"{path}/*{suffix}", lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r$", "").alias("line"))
    lines = lines.withColumn("_n", F.row_number().over(Window.partitionBy("file", "start").orderBy("_id")))
    sizes = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n")).withColumn("GenomeID", _stem(F.col("file"), suffix))
    blocks = Window.partitionBy("GenomeID").orderBy("file", "start")
    before = F.coalesce(F.sum("n").over(blocks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("file", "start", "GenomeID", F.row_number().over(blocks).alias("part"), before.alias("before"))
    return lines.join(parts, ["file", "start"]).select("GenomeID", "part", (F.col("before") + F.col("_n") - 1).alias("pos"), "line")


def _named(names: list[str], n: str) -> Column:
    """The field of a name by its place in the header, empty where the row is too short, null where the header lacks it."""
    place = F.get("places", F.lit(names.index(n)))
    return F.when(place > 0, F.coalesce(F.get("fields", place - 1), F.lit("")))


def _padded(fields: str, i: int) -> Column:
    """Field i, empty where the row is too short; fields beyond the header are not asked for."""
    return F.coalesce(F.get(fields, F.lit(i)), F.lit(""))


def read_isomodels(spark: SparkSession, path: str, suffix: str = ISO_SUFFIX, scores: list[str] = ISOTYPES, packed: bool = False) -> DataFrame:
    """GenomeID, tRNAscanID, Anticodon_predicted_isotype and a column a score; the first line that isn't blank is the header.

    Columns are taken by the names of the report's own header. Of equal ids in a report the last row counts.
    """
    names = ["Anticodon_predicted_isotype", *scores]
    if packed:
        told = F.filter("lines", lambda x: F.trim(x) != "")
        rows = _packed_lines(spark, path, suffix, F.exists("lines", lambda x: F.trim(x) != ""), split_fields(F.get(told, F.lit(0))), names)
        rows = rows.where("not header")
    else:
        rows = _lines(spark, path, suffix).where(F.trim("line") != "").withColumn("fields", split_fields(F.col("line")))
        heads = rows.groupBy("GenomeID").agg(F.min(F.struct("pos", "fields")).alias("head"))
        heads = heads.select("GenomeID", F.col("head.pos").alias("first"), F.array(*[F.array_position("head.fields", n).cast("int") for n in names]).alias("places"))
        rows = rows.join(heads, "GenomeID").where("pos > first")
    value = lambda n: _named(names, n)
    out = rows.select("GenomeID", "pos", _padded("fields", 0).alias("tRNAscanID"), *[value(n).alias(n) for n in names])
    return last_by_key(out, ["GenomeID", "tRNAscanID"], "pos").drop("pos")


def dedupe_header(names: Column, renames: dict[str, str]) -> Column:
    """A header's names: a second occurrence of one is renamed, or numbered if it has no new name, further ones numbered."""
    second = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])

    def name(x: Column, all_names: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(all_names, 1, i + 1), lambda y: y == x))
        numbered = F.concat(x, F.lit("_"), nth.cast("string"))
        return F.when(nth == 1, x).when(nth == 2, F.coalesce(F.try_element_at(second, x), numbered)).otherwise(numbered)

    return F.transform(names, lambda x, i: name(x, names, i))


def read_scan_report(spark: SparkSession, path: str, suffix: str = MAIN_SUFFIX, columns: list[str] = MAIN_COLUMNS, renames: dict[str, str] = MAIN_RENAMES, packed: bool = False) -> DataFrame:
    """GenomeID, tRNAscanID and the columns of main reports: names on the second line, data from the fourth on.

    Columns are taken by the names of the report's own header, '' where a row is too short, null where the header has no
    such name. Shorter reports have no rows. Of equal ids in a report the last row counts.
    """
    names = list(dict.fromkeys(["Name", "tRNA #", *columns]))
    if packed:
        second = (1 - F.col("at")).cast("int")
        own = (F.col("at") <= 1) & (F.size("lines") > second)
        data = _packed_lines(spark, path, suffix, own, dedupe_header(split_fields(F.get("lines", second)), renames), names).where("pos >= 3")
    else:
        rows = _lines(spark, path, suffix).withColumn("fields", split_fields(F.col("line")))
        heads = rows.where("pos = 1").select("GenomeID", dedupe_header(F.col("fields"), renames).alias("head"))
        heads = heads.select("GenomeID", F.array(*[F.array_position("head", n).cast("int") for n in names]).alias("places"))
        data = rows.where((F.col("pos") >= 3) & (F.trim("line") != "")).join(heads, "GenomeID")
    value = lambda n: _named(names, n)
    key = F.concat(F.coalesce(value("Name"), F.lit("")), F.lit(".trna"), F.coalesce(value("tRNA #"), F.lit("")))
    return last_by_key(data.select("GenomeID", "pos", key.alias("tRNAscanID"), *[value(n).alias(n) for n in columns]), ["GenomeID", "tRNAscanID"], "pos").drop("pos")


def _packed_blocks(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """GenomeID, at, pos, id, seq and str of each block of structure reports in packs; what a record begins with may belong to the block before."""
    records = _bodies(spark, path, suffix)
    parts = records.select("GenomeID", "at", F.posexplode(F.split("body", r"\n(?=[^\n]*Length:)")).alias("i", "block"))
    parts = parts.select("GenomeID", "at", (F.col("at") + F.col("i")).alias("pos"), F.explode(F.array(F.transform(F.split("block", "\n"), lambda x: F.trim(x)))).alias("lines"))
    said = lambda mark: F.array_max(F.transform(F.filter("lines", lambda x: x.startswith(mark)), lambda x: F.trim(F.substring(x, F.lit(len(mark) + 1), F.length(x)))))
    key = F.when(F.get("lines", F.lit(0)).contains("Length:"), F.get(F.split(F.get("lines", F.lit(0)), r"\s+"), F.lit(0)))
    blocks = parts.select("GenomeID", "at", "pos", key.alias("id"), said("Seq:").alias("seq"), said("Str:").alias("str"))
    if not records.where(~F.substring_index("body", "\n", 1).contains("Length:")).limit(1).count():
        return blocks
    before = Window.partitionBy("GenomeID").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    lasts = blocks.groupBy("GenomeID", "at").agg(F.max(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))).alias("last")).select("GenomeID", "at", F.max("last").over(before).alias("earlier"))
    rest = blocks.where("id is null").drop("pos", "id").join(lasts.where("earlier is not null"), ["GenomeID", "at"])
    return blocks.where("id is not null").unionByName(rest.select("GenomeID", "at", "earlier.pos", "earlier.id", "seq", "str"))


def read_structures(spark: SparkSession, path: str, suffix: str = STRUCT_SUFFIX, packed: bool = False) -> DataFrame:
    """GenomeID, tRNAscanID, primary_sequence (upper case) and secondary_structure of blocks that have a structure."""
    if packed:
        blocks = _packed_blocks(spark, path, suffix).where("id is not null").withColumnRenamed("id", "tRNAscanID").repartition("GenomeID", "tRNAscanID")
        out = blocks.groupBy("GenomeID", "tRNAscanID", "pos").agg(F.upper(F.coalesce(F.max("seq"), F.lit(""))).alias("primary_sequence"), F.max("str").alias("secondary_structure"))
        return last_by_key(out.where("secondary_structure is not null"), ["GenomeID", "tRNAscanID"], "pos").drop("pos")
    lines = _lines(spark, path, suffix)
    key = F.when(F.col("line").contains("Length:"), F.get(F.split(F.trim("line"), r"\s+"), F.lit(0)))
    begun = lines.withColumn("begun", F.when(key.isNotNull(), F.struct(F.col("pos").alias("at"), key.alias("id"))))
    # Begun in the same part, or else the last one begun in the parts before.
    w = Window.partitionBy("GenomeID", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("GenomeID").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lasts = begun.groupBy("GenomeID", "part").agg(F.max("begun").alias("last")).select("GenomeID", "part", F.max("last").over(before).alias("earlier"))
    blocks = begun.withColumn("own", F.last("begun", ignorenulls=True).over(w)).join(lasts, ["GenomeID", "part"])
    blocks = blocks.withColumn("block", F.coalesce("own", "earlier")).where("block is not null")
    part = lambda mark: F.max(F.when(F.trim("line").startswith(mark), F.trim(F.substring(F.trim("line"), F.lit(len(mark) + 1), F.length("line")))))
    out = blocks.groupBy("GenomeID", "block").agg(F.upper(F.coalesce(part("Seq:"), F.lit(""))).alias("primary_sequence"), part("Str:").alias("secondary_structure"))
    out = out.where("secondary_structure is not null").select("GenomeID", F.col("block.id").alias("tRNAscanID"), F.col("block.at").alias("pos"), "primary_sequence", "secondary_structure")
    return last_by_key(out, ["GenomeID", "tRNAscanID"], "pos").drop("pos")


__all__ = ["dedupe_header", "file_manifest", "read_isomodels", "read_scan_report", "read_structures", "write_packs"]
