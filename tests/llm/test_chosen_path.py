import random

from annot.llm.chosen_path import DEPTH, components, drop_near_duplicates, miss, near_duplicates, runs_needed

from .cases import crowded, odd_rows, table, words


def shingle_set(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    different = sorted(set(sets), key=lambda s: min((i is not None, i or 0) for (i, _), x in zip(rows, sets, strict=True) if x == s))
    links = {s: {t for t in different if t != s and s and t and len(s & t) >= threshold * len(s | t)} for s in different}
    least = {s: min((i is not None, i or 0) for (i, _), x in zip(rows, sets, strict=True) if x == s) for s in different}
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        seen, todo = {s}, [s]
        while todo:
            for t in links[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        root, copy = min(least[t] for t in seen), least[s]
        out.append((str(i), str(root[1] if root[0] else None), str(copy[1] if copy[0] else None), sets.count(s), len(links[s])))
    return sorted(out)


def near_rows(n_groups, copies, seed=3):
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        base = words(rng, rng.randint(60, 200)).split()
        for c in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"changed{rng.randint(0, 9)}"
            rows.append((g * 1000 + c, " ".join(w)))
    return rows


def found(df, **options):
    return sorted((str(r.doc_id), str(r.class_id), str(r.copy_id), r.n_copies, r.n_links) for r in near_duplicates(df, **options).collect())


def test_links_equal_brute_force(spark):
    rows = near_rows(12, 6) + odd_rows()
    assert found(crowded(table(spark, rows))) == plain(rows)


def test_large_group_in_blocks(spark):
    rows = near_rows(1, 150, seed=9) + near_rows(3, 2, seed=10)[2:]
    assert found(table(spark, rows), block=20) == plain(rows)


def test_one_of_each_group_stays(spark):
    rows = near_rows(6, 5) + [(1, None), (2, ""), (2, "")]
    kept = drop_near_duplicates(crowded(table(spark, rows)))
    assert kept.columns == crowded(table(spark, rows)).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({int(r[1]) for r in plain(rows)})
    assert drop_near_duplicates(table(spark, [])).count() == 0


def test_pairs_with_a_passage_that_all_share(spark):
    """Nodes stay large to great depths where all texts hold one passage, and pairs in them are still met."""
    rng, rows = random.Random(21), []
    passage = words(rng, 60)
    for g in range(150):
        own = words(rng, 24, [f"v{i}" for i in range(3000)]).split()
        for c in range(2):
            w = list(own)
            if c:
                w[rng.randrange(24)] = "changed"
            rows.append((2 * g + c, " ".join(w[:12]) + " " + passage + " " + " ".join(w[12:])))
    assert found(table(spark, rows)) == plain(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + rng.randrange(i + 1)) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)] + [(5, 5), (9, 8)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {x: top(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), "test").count() == 0


def test_runs():
    assert runs_needed(0.8, 0.99) < runs_needed(0.8, 0.9999) < runs_needed(0.8, 0.9999, DEPTH) < 60
    assert miss(0.8, runs_needed(0.8, 0.9999), 3) <= 1e-4
