import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from annot.llm.exact_dedup import drop_exact_copies, exact_groups, text_identities

from .cases import crowded, odd_rows, table


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    key = lambda i: (i is not None, i or 0)
    return sorted((str(i), str(max(groups[lower(t)], key=key)), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


def found(df, **options):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in exact_groups(df, **options).collect())


def test_groups_are_those_of_equal_texts(spark):
    rows = odd_rows()
    for size in (4, 64, 4096):
        assert found(crowded(table(spark, rows)), block_bytes=size) == expected(rows)


def test_blocks_with_one_hash_are_told_apart(spark):
    rows = odd_rows()
    few = lambda b: F.pmod(F.crc32(b), F.lit(2))
    assert found(table(spark, rows), block_bytes=16, block_hash=few) == expected(rows)


def test_one_row_of_a_group_is_kept(spark):
    rows = odd_rows()
    kept = exact_groups(table(spark, rows)).where("kept").collect()
    assert len(kept) == len({lower(t) for _, t in rows})
    left = drop_exact_copies(crowded(table(spark, rows)))
    assert left.columns == crowded(table(spark, rows)).columns
    assert sorted(lower(r.text) for r in left.collect()) == sorted({lower(t) for _, t in rows})


def test_empty_table(spark):
    assert text_identities(table(spark, [])).count() == 0
    assert drop_exact_copies(table(spark, [])).count() == 0
