"""Packing without a bound on the search: as few bins as any packing has."""

import random

from annot.llm.packing import branch_and_bound, pack

from .cases import words


def fewest(sizes, cap):
    best = len(sizes)

    def rec(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[i]:
                rest = list(rooms)
                rest.remove(room)
                rec(i + 1, [*rest, room - sizes[i]])
        rec(i + 1, [*rooms, cap - sizes[i]])

    rec(0, [])
    return best


def test_search_to_the_end_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        cap = rng.choice([11, 17, 30])
        sizes = sorted((rng.randint(1, cap - 1) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = branch_and_bound(sizes, cap, None)
        assert sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= cap
        assert len(bins) == fewest(sizes, cap)


def test_copies_of_a_filling_can_be_used_fewer_times_than_they_fit():
    for sizes, cap in (([6, 6, 5, 5, 4, 4, 3, 3], 12), ([7, 7, 7, 5, 5, 4, 4, 3, 3, 3], 16), ([9, 9, 8, 8, 5, 5, 4, 4, 4, 4], 20)):
        assert len(branch_and_bound(sizes, cap, None)) == fewest(sizes, cap)


def test_pack_hands_the_bound_on(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, words(rng, rng.randint(1, 9))) for i in range(9)], "doc_id long, text string")
    rows = pack(docs, length=32, nodes=None).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    whole = sum(r.length == 32 for r in rows)
    assert len(used) == whole + fewest(sorted((r.length for r in rows if r.length < 32), reverse=True), 32)
