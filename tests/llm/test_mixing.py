import random

from annot.llm.mixing import mix, mixed_rows, sainte_lague

from .cases import crowded, odd_rows, table, words


def test_seats_go_to_the_highest_quotients(spark):
    rng = random.Random(3)
    rows = [(g, f"p{p:02}", float(rng.choice([0, 1, 2, 5, 90, rng.randint(1, 4000)])), m) for g, m in ((0, 1), (1, 7), (2, 100), (3, 1003)) for p in range(rng.randint(1, 25))]
    got = {(r.g, r.p): r.won for r in sainte_lague(spark.createDataFrame(rows, "g int, p string, v double, m long"), ["g"], "p", "v", "m").collect()}
    for g in range(4):
        party = [(p, v) for gg, p, v, _ in rows if gg == g]
        seats = next(m for gg, _, _, m in rows if gg == g)
        quotients = sorted(((-v / (2 * j + 1), p) for p, v in party for j in range(seats)))[:seats]
        want = {p: sum(q[1] == p for q in quotients) for p, _ in party} if sum(v for _, v in party) else {p: 0 for p, _ in party}
        assert {p: got[g, p] for p, _ in party} == want


def targets(sizes, weights):
    """The contract, step by step: shares by weight, the excess of full sources reshared until none is above."""
    left, total, out = dict(weights), 1.5 * sum(sizes.values()), {}
    while left:
        share = {s: total * w / sum(left.values()) for s, w in left.items()}
        full = [s for s in left if share[s] > 2 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            total -= out[s]
            del left[s]
    return out


def test_taken_words_come_near_targets(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 400)), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(900)]
    got = mix(crowded(table(spark, rows)), shard_rows=100).collect()
    sizes = {}
    for r, row in zip(sorted(got, key=lambda r: r.doc_id), rows, strict=True):
        assert r.size == len(row[1].split()) and 0 <= r.taken <= 2 * r.size
        sizes[row[2]] = sizes.get(row[2], 0) + r.size
    names = sorted((s for s in sizes if s), key=str) + [None]
    want = targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)})
    source = {i: s for i, _, s in rows}
    for s in names:
        mine = [r for r in got if source[r.doc_id] == s]
        assert abs(mine[0].target - want[s]) < 1e-6
        assert abs(sum(r.taken for r in mine) - want[s]) < 32 * 10
    again = mix(table(spark, rows[::-1]), shard_rows=100).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_odd_rows_and_empty_table(spark):
    rows = odd_rows()
    assert mix(crowded(table(spark, rows))).count() == len(rows)
    assert mix(table(spark, [])).count() == 0
    assert mix(table(spark, [(1, None), (2, "")])).where("taken > 0").count() == 0
    assert mixed_rows(crowded(table(spark, rows))).columns == crowded(table(spark, rows)).columns
