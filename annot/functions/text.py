"""Column functions on strings and sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from annot.schema import BASES


def split_fields(c: Column) -> Column:
    """Fields between tabs or runs of two or more blanks, trimmed; empty ones are dropped."""
    return F.filter(F.transform(F.split(c, r"\t+|\s{2,}"), lambda x: F.trim(x)), lambda x: x != "")


def safe_name(c: Column, ascii_only: bool = False) -> Column:
    """A name fit for a file: other than word characters, '-' and '.' become '_'; an empty or null one is 'unknown'."""
    pattern = r"[^A-Za-z0-9_\-.]" if ascii_only else r"(?U)[^\w\-.]"
    return F.coalesce(F.nullif(F.regexp_replace(c, pattern, "_"), F.lit("")), F.lit("unknown"))


def no_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "_")


def normalize_seq(c: Column, u_to_t: bool = True) -> Column:
    """Upper case; U becomes T."""
    return F.translate(F.upper(c), "U", "T") if u_to_t else F.upper(c)


def find_in_loop(seq: Column, codon: Column, structure: Column) -> Column:
    """0-based place of the first occurrence of a 3-letter codon within a run of five or more dots of the structure.

    At least one dot of the run stands before it; null where there is none, or where anything is null.
    """
    def first(x: Column) -> Column:
        letter = lambda i: F.get(x["s"], i)
        dot = lambda i: F.coalesce(F.get(x["d"], i) == ".", F.lit(False))
        places = F.when(F.size(x["s"]) >= 4, F.sequence(F.lit(1), F.size(x["s"]) - 3)).otherwise(F.array().cast("array<int>"))
        # Four dots from one before the codon to its end, and a fifth one beside them.
        around = lambda p: dot(p - 1) & dot(p) & dot(p + 1) & dot(p + 2) & (dot(p - 2) | dot(p + 3))
        return F.array_min(F.filter(places, lambda p: around(p) & (F.concat(letter(p), letter(p + 1), letter(p + 2)) == x["c"])))

    # The letters are split once and bound as x: what a lambda closes over is evaluated again at each place.
    parts = F.struct(F.split(seq, "").alias("s"), F.split(structure, "").alias("d"), codon.alias("c"))
    return F.get(F.transform(F.array(parts), first), F.lit(0))


def masked(seq: Column, start: Column, width: int = 3) -> Column:
    """seq with N over `width` letters from the 0-based start on; as it is where start is null."""
    return F.when(start.isNull(), seq).otherwise(F.concat(F.substring(seq, F.lit(1), start), F.lit("N" * width), F.substring(seq, start + width + 1, F.length(seq))))


def one_hot(seq: Column, length: int, u_to_t: bool = True) -> Column:
    """Array of 5 x length doubles: for each place A, C, G, T, N; unknown letters are N, places past the end are zeros.

    A null sequence counts as empty.
    """
    code = {b: F.array(*[F.lit(float(b == x)) for x in BASES]) for b in BASES}
    letters = F.slice(F.filter(F.split(F.coalesce(normalize_seq(seq, u_to_t), F.lit("")), ""), lambda x: x != ""), 1, max(length, 1))
    def known(x: Column) -> Column:
        return F.when(x == "A", code["A"]).when(x == "C", code["C"]).when(x == "G", code["G"]).when(x == "T", code["T"]).otherwise(code["N"])
    return F.slice(F.concat(F.flatten(F.transform(letters, known)), F.array_repeat(F.lit(0.0), 5 * length)), 1, 5 * length)


def interval_length(begin: Column, end: Column, lo: float, hi: float) -> Column:
    """abs(end - begin), clipped; null if either is."""
    n = F.abs(end - begin)
    return F.when(n.isNotNull(), F.greatest(F.least(n, F.lit(hi)), F.lit(lo)))
