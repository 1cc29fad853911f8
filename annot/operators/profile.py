"""Statistics of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annot.operators.quantiles import beside, describe, exact_quantiles
from annot.sources.shared import written


def overview(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """n_rows, the distinct values of each unit (name -> column), n_columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(n) for n, c in units.items()], F.lit(len(df.columns)).alias("n_columns"))


def missing_values(df: DataFrame) -> DataFrame:
    """column, n_missing, pct for columns with nulls; all in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = row.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_missing")) for c in df.columns])).alias("x"))
    return long.where("x.n_missing > 0").select("x.column", "x.n_missing", (100.0 * F.col("x.n_missing") / F.col("_n")).alias("pct"))


def describe_exact(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row of statistics for each column with a value: count, mean, std, min, exact quartiles, max."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x"))
    return describe(long.select("x.column", "x.v"), ["column"], "v")


def count_per_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def count_per_key_describe(df: DataFrame, key: str) -> DataFrame:
    """Statistics of the number of rows a key."""
    return describe(count_per_key(df, key).select(F.col("n").alias("v")), [], "v")


def extreme_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys with most and fewest rows; of equal ones the first."""
    counts = count_per_key(df, key)
    most = counts.orderBy(F.col("n").desc(), key).limit(1).select(F.lit("most").alias("which"), key, "n")
    least = counts.orderBy("n", key).limit(1).select(F.lit("fewest").alias("which"), key, "n")
    return most.unionByName(least)


def distribution(df: DataFrame, column: str, null_as: str | None = None) -> DataFrame:
    """value, n, pct of all rows. Nulls are left out, or counted as null_as."""
    value = F.col(column) if null_as is None else F.coalesce(F.col(column), F.lit(null_as))
    counts = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return beside(counts, total, []).where("value is not null").select("value", "n", (100.0 * F.col("n") / F.col("_total")).alias("pct"))


def distribution_canonical(df: DataFrame, column: str, canonical: list[str]) -> DataFrame:
    """value, n, pct of the canonical total; noise is one row, 'noise', without pct."""
    known = F.col(column).isin(canonical)
    rows = df.where(F.col(column).isNotNull()).groupBy(F.when(known, F.col(column)).otherwise("noise").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    good = F.col("value") != "noise"
    total = rows.agg(F.sum(F.when(good, F.col("n"))).alias("_total"))
    return beside(rows, total, []).select("value", "n", F.when(good, 100.0 * F.col("n") / F.col("_total")).alias("pct"))


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """value and n of the k most frequent values; of equal ones the first."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def quality_flags(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """flag, n, pct; flags may overlap."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    long = row.select("_n", F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in flags])).alias("x"))
    return long.select("x.flag", "x.n", (100.0 * F.col("x.n") / F.col("_n")).alias("pct"))


def quality_flags_exclusive(df: DataFrame, pseudo: Column, trunc: Column, intron: Column) -> DataFrame:
    """Buckets of a figure: pseudo and truncated rows apart from those that are both; introns are counted whatever else holds."""
    flags = {"pseudo_only": pseudo & ~trunc, "trunc_only": trunc & ~pseudo, "pseudo_and_trunc": pseudo & trunc, "intron": intron, "clean": ~pseudo & ~trunc & ~intron}
    return quality_flags(df, flags)


def crosstab_pct(df: DataFrame, row: str, column: str, rows: list, columns: list) -> DataFrame:
    """Shares, in percent of all of a row's values, of the given columns; for the given rows only, absent ones 0."""
    kept = df.where(F.col(row).isin(rows) & F.col(column).isNotNull())
    counts = kept.groupBy(row).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(column) == c).alias(str(c)) for c in columns])
    return counts.select(row, *[(100.0 * F.col(f"`{c}`") / F.col("_n")).alias(str(c)) for c in columns])


def quantiles_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, q25, q50, q75, ordered by median."""
    return exact_quantiles(df.where(F.col(key).isNotNull()), [key], value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).orderBy("q50", key)


def mean_matrix(df: DataFrame, key: str, columns: list[str], sentinel: float | None = None, when: str = "after_mean") -> DataFrame:
    """Mean of each column a key. The sentinel becomes null after the mean (only a mean equal to it does), or before."""
    def mean(c: str) -> Column:
        if sentinel is None:
            return F.avg(c)
        return F.nullif(F.avg(c), F.lit(sentinel)) if when == "after_mean" else F.avg(F.nullif(F.col(c), F.lit(sentinel)))

    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[mean(c).alias(c) for c in columns])


def own_vs_best(matrix: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, own (the column named as the key), best_column, best; of equal columns the first."""
    entries = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(columns)])
    best = F.array_max(F.filter(entries, lambda x: x["v"].isNotNull()))
    own = F.get(F.filter(entries, lambda x: x["c"] == F.col(key)), F.lit(0))["v"]
    return matrix.select(key, own.alias("own"), best["c"].alias("best_column"), best["v"].alias("best"))


def mean_composition(df: DataFrame, unit: str, category: str) -> DataFrame:
    """category and its share of a unit's rows, in percent, averaged over all units; 0 where a unit has none."""
    rows = df.where(F.col(unit).isNotNull() & F.col(category).isNotNull())
    parts = rows.groupBy(unit, category).agg(F.count(F.lit(1)).alias("n"))
    shares = parts.join(parts.groupBy(unit).agg(F.sum("n").alias("total")), unit).withColumn("share", 100.0 * F.col("n") / F.col("total"))
    by = shares.groupBy(category).agg(F.sum("share").alias("s"))
    units = parts.agg(F.count_distinct(unit).alias("units"))
    return beside(by, units, []).select(category, (F.col("s") / F.col("units")).alias("mean_pct"))


def histogram(df: DataFrame, column: str, bins: int, density: bool = False, by: str | None = None, weight: str | None = None) -> DataFrame:
    """bin (from 0), lo, hi, n and, if asked for, density. Equal widths over each group's own range, the last bin closed.

    A range of one value is widened by half on either side. Empty bins have a row. A row counts `weight` times, if given.
    """
    keys = [by] if by else []
    v = F.col(column).cast("double")
    w = F.col(weight) if weight else F.lit(1)
    rows = df.where(v.isNotNull()).select(*keys, v.alias("v"), w.cast("long").alias("_w"))
    ends = rows.groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"), F.sum("_w").alias("total"))
    one = F.col("a") == F.col("b")
    ends = ends.where("total > 0").select(*keys, "total", F.when(one, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(one, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    placed = beside(rows, ends, keys).select(*keys, "_w", F.least(F.floor((F.col("v") - F.col("a")) / ((F.col("b") - F.col("a")) / bins)), F.lit(bins - 1)).cast("int").alias("bin"))
    counts = placed.groupBy(*keys, "bin").agg(F.sum("_w").alias("n"))
    width = (F.col("b") - F.col("a")) / bins
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cols = [*keys, "bin", (F.col("a") + F.col("bin") * width).alias("lo"), (F.col("a") + (F.col("bin") + 1) * width).alias("hi"), "n"]
    return out.select(*cols, *([(F.col("n") / (F.col("total") * width)).alias("density")] if density else []))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int) -> DataFrame:
    """lattice (1 or 2), i, j and n of the cells of a hexagonal grid that hold points.

    Each point goes to the nearer of its places on two lattices, of which the second is half a step off.
    """
    nx, ny = gridsize, int(gridsize / 3**0.5)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ends = rows.agg(*[f(c).alias(f"{c}{n}") for c in "xy" for f, n in ((F.min, 0), (F.max, 1))])
    scale = lambda c, n: F.when(F.col(f"{c}1") > F.col(f"{c}0"), (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * n).otherwise(0.0)
    uv = beside(rows, ends, []).select(scale("x", nx).alias("u"), scale("y", ny).alias("v"))
    near = lambda c: F.floor(F.col(c) + 0.5)
    half = lambda c: F.floor(c) + 0.5
    d1 = (F.col("u") - near("u")) ** 2 + 3 * (F.col("v") - near("v")) ** 2
    d2 = (F.col("u") - half("u")) ** 2 + 3 * (F.col("v") - half("v")) ** 2
    first = d1 < d2
    cells = uv.select(F.when(first, 1).otherwise(2).alias("lattice"), F.when(first, near("u")).otherwise(F.floor("u")).cast("long").alias("i"), F.when(first, near("v")).otherwise(F.floor("v")).cast("long").alias("j"))
    return cells.groupBy("lattice", "i", "j").agg(F.count(F.lit(1)).alias("n"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """The n rows with the least hash of key and seed, all if there are fewer; the same rows each time."""
    at = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_at", at).orderBy("_at", key).limit(n).drop("_at")


def value_counts(df: DataFrame, entries: list[tuple]) -> DataFrame:
    """slot, a, b, v and n: how often each entry (slot, a, b, v, condition) of a row occurs; one scan and one exchange.

    Equal entries meet in a partial aggregation, so that a frequent value isn't sent to one task.
    """
    def entry(slot: str, a: Column | None = None, b: Column | None = None, v: Column | None = None, when: Column | None = None) -> Column:
        kinds = (F.lit(slot), "string", "slot"), (a, "string", "a"), (b, "string", "b"), (v, "double", "v")
        whole = F.struct(*[(F.lit(None) if x is None else x).cast(kind).alias(name) for x, kind, name in kinds])
        return whole if when is None else F.when(when, whole)

    rows = df.select(F.explode(F.array_compact(F.array(*[entry(*e) for e in entries]))).alias("x"))
    return rows.groupBy("x.slot", "x.a", "x.b", "x.v").agg(F.count(F.lit(1)).alias("n"))


def profile_report(
    df: DataFrame, units: dict[str, str], categories: list[str], numbers: list[str], key: str, flags: dict[str, Column] | None = None, exclusive: tuple[Column, Column, Column] | None = None,
    canonical: dict[str, list[str]] | None = None, top: dict[str, int] | None = None, shares: tuple[str | Column, str | Column] | None = None, quantiles: tuple[str, str] | None = None,
    matrix: tuple[str, list[str]] | None = None, sentinel: float | None = None, composition: tuple[str, str] | None = None, bins: int = 0,
) -> DataFrame:
    """section, key, stat, value: the statistics of a table in one long frame.

    The table is read once: what any section needs is counted as entries of value_counts, a table of distinct values that all
    sections then read. Sections: overview (units: name -> column), missing (all columns), rows_per_key, extreme_keys,
    numbers, distribution:<category>; where asked for flags and flags_exclusive (pseudo, trunc, intron), canonical:<column>
    with noise, top:<column>, crosstab (row, column; names or expressions) in percent of a row's values, quantiles (key, value), matrix (key, columns)
    of means, with a sentinel that is null where a mean equals it, and own_vs_best of these, composition (unit, category), and
    a histogram of `bins` bins for each number. Null keys and values are left out as in the operators of these names; an
    empty table gives the overview alone, with zeros. Sampling and the hexagonal grid are for figures and aren't here.
    """
    flags, canonical, top = flags or {}, canonical or {}, top or {}
    if exclusive:
        p, t, i = exclusive
        apart = {"pseudo_only": p & ~t, "trunc_only": t & ~p, "pseudo_and_trunc": p & t, "intron": i, "clean": ~p & ~t & ~i}
    col = lambda c: c if isinstance(c, Column) else F.col(f"`{c}`")
    entries: list[tuple] = [("all",)]
    entries += [("missing", F.lit(c), None, None, col(c).isNull()) for c in df.columns]
    entries += [("flag", F.lit(n), None, None, c) for n, c in flags.items()] + [("exclusive", F.lit(n), None, None, c) for n, c in (apart.items() if exclusive else ())]
    entries += [(f"value:{c}", col(c), None, None, col(c).isNotNull()) for c in dict.fromkeys([*units.values(), key, *categories, *canonical, *top])]
    entries += [(f"number:{c}", None, None, col(c), col(c).isNotNull()) for c in dict.fromkeys(numbers)]
    for slot, pair in (("crosstab", shares), ("composition", composition)):
        entries += [(slot, col(pair[0]), col(pair[1]), None, col(pair[0]).isNotNull() & col(pair[1]).isNotNull())] if pair else []
    entries += [("quantiles", col(quantiles[0]), None, col(quantiles[1]), col(quantiles[0]).isNotNull() & col(quantiles[1]).isNotNull())] if quantiles else []
    entries += [("matrix", col(matrix[0]), F.lit(c), col(c), col(matrix[0]).isNotNull()) for c in matrix[1]] if matrix else []
    counts = written(value_counts(df, entries), "profile")
    slot = lambda name: counts.where(F.col("slot") == name)

    def long(section: str, part: DataFrame, label: Column, stats: list[str]) -> DataFrame:
        return part.select(F.lit(section).alias("section"), label.cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in stats])).alias("x")).select("section", "key", "x.stat", "x.value")

    total = counts.agg(F.coalesce(F.sum(F.when(F.col("slot") == "all", F.col("n"))), F.lit(0)).alias("n_rows"), *[F.count_if(F.col("slot") == f"value:{c}").alias(n) for n, c in units.items()], F.lit(len(df.columns)).alias("n_columns"))
    rows = slot("all").agg(F.sum("n").alias("_n"))

    def shared(part: DataFrame) -> DataFrame:
        return beside(part, rows, []).withColumn("pct", 100.0 * F.col("n") / F.col("_n"))

    def named(name: str, labels: list[str]) -> DataFrame:
        """A row for each label, 0 where it has none."""
        all_ = rows.where("_n > 0").select(F.explode(F.array(*map(F.lit, labels))).alias("a"))
        return all_.join(slot(name).select("a", "n"), "a", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    stats = ["n", "mean", "std", "min", "p25", "p50", "p75", "max"]
    per_key = slot(f"value:{key}").select("a", "n")
    of_numbers = counts.where(F.col("slot").startswith("number:")).select(F.substring("slot", 8, 1 << 20).alias("column"), "v", "n")
    ordered = lambda part, k, *order: part.orderBy(*order).limit(k)
    parts = [
        long("overview", total, F.lit("all"), ["n_rows", *units, "n_columns"]),
        long("missing", shared(slot("missing")).withColumnRenamed("n", "n_missing"), F.col("a"), ["n_missing", "pct"]),
        long("rows_per_key", describe(per_key.select(F.col("n").alias("v")), [], "v").where("n > 0"), F.lit(key), stats),
        long("extreme_keys", ordered(per_key, 1, F.col("n").desc(), "a").withColumnRenamed("n", "most"), F.col("a"), ["most"]),
        long("extreme_keys", ordered(per_key, 1, "n", "a").withColumnRenamed("n", "fewest"), F.col("a"), ["fewest"]),
        long("numbers", describe(of_numbers.withColumnRenamed("n", "w"), ["column"], "v", weight="w"), F.col("column"), stats),
        *[long(f"distribution:{c}", shared(slot(f"value:{c}")), F.col("a"), ["n", "pct"]) for c in categories],
        *[long(f"top:{c}", ordered(slot(f"value:{c}"), k, F.col("n").desc(), "a"), F.col("a"), ["n"]) for c, k in top.items()],
    ]
    if flags:
        parts.append(long("flags", shared(named("flag", list(flags))), F.col("a"), ["n", "pct"]))
    if exclusive:
        parts.append(long("flags_exclusive", shared(named("exclusive", list(apart))), F.col("a"), ["n", "pct"]))
    for c, known in canonical.items():
        kinds = slot(f"value:{c}").groupBy(F.when(F.col("a").isin(known), F.col("a")).otherwise("noise").alias("a")).agg(F.sum("n").alias("n"))
        good = F.col("a") != "noise"
        kinds = beside(kinds, kinds.agg(F.sum(F.when(good, F.col("n"))).alias("_n")), [])
        parts.append(long(f"canonical:{c}", kinds.withColumn("pct", F.when(good, 100.0 * F.col("n") / F.col("_n"))), F.col("a"), ["n", "pct"]))
    if shares:
        of_row = slot("crosstab").groupBy("a").agg(F.sum("n").alias("_n"))
        pairs = slot("crosstab").join(of_row, "a").withColumns({"pct": 100.0 * F.col("n") / F.col("_n"), "stat": F.col("b")})
        parts.append(pairs.select(F.lit("crosstab").alias("section"), F.col("a").alias("key"), "stat", F.col("pct").alias("value")))
    if quantiles:
        by = exact_quantiles(slot("quantiles").select("a", "v", F.col("n").alias("w")), ["a"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, weight="w")
        parts.append(long("quantiles", by, F.col("a"), ["n", "q25", "q50", "q75"]))
    if matrix:
        names = matrix[1]
        mean = lambda c: F.sum(F.when(F.col("b") == c, F.col("v") * F.col("n"))) / F.sum(F.when((F.col("b") == c) & F.col("v").isNotNull(), F.col("n")))
        means = slot("matrix").groupBy("a").agg(*[(mean(c) if sentinel is None else F.nullif(mean(c), F.lit(float(sentinel)))).alias(c) for c in names])
        parts.append(long("matrix", means, F.col("a"), names))
        best = own_vs_best(means, "a", names).select("a", F.col("own"), F.col("best"), F.col("best_column"))
        parts.append(long("own_vs_best", best, F.concat_ws(":", "a", "best_column"), ["own", "best"]))
    if composition:
        of_unit = slot("composition").groupBy("a").agg(F.sum("n").alias("_t"))
        share = slot("composition").join(of_unit, "a").groupBy("b").agg(F.sum(100.0 * F.col("n") / F.col("_t")).alias("_s"))
        parts.append(long("composition", beside(share, of_unit.agg(F.count(F.lit(1)).alias("_u")), []).withColumn("mean_pct", F.col("_s") / F.col("_u")), F.col("b"), ["mean_pct"]))
    if bins:
        grid = histogram(of_numbers, "v", bins, by="column", weight="n")
        parts.append(grid.select(F.concat(F.lit("histogram:"), "column").alias("section"), F.col("bin").cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("value")) for s in ("lo", "hi", "n")])).alias("x")).select("section", "key", "x.stat", "x.value"))
    return reduce(DataFrame.unionByName, parts)
