"""Fixed values of annotation tables: categories, ranks and schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# The score columns of a model report, which are also the canonical categories.
ISOTYPES = ["Ala", "Arg", "Asn", "Asp", "Cys", "Gln", "Glu", "Gly", "His", "Ile", "Ile2", "Leu", "Lys", "Met", "Phe", "Pro", "SeC", "Ser", "Thr", "Trp", "Tyr", "Val", "fMet"]
EXTRA_ISOTYPES = ["Undet", "Sup"]
# Taxonomic ranks and the prefixes of their names in a lineage.
RANKS = ["domain", "phylum", "class", "order", "family", "genus", "species"]
PREFIXES = ["d__", "p__", "c__", "o__", "f__", "g__", "s__"]
#: The value that stands for no score.
NO_SCORE = -999.0
BASES = "ACGTN"

# The columns that are kept of a main report, and the names of its second Begin, End and Score.
MAIN_COLUMNS = ["Name", "tRNA #", "Begin", "End", "Codon", "intron_begin", "intron_end", "Score", "CM", "conf_score", "Note"]
MAIN_RENAMES = {"Begin": "intron_begin", "End": "intron_end", "Score": "conf_score"}


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
