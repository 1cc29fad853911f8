import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from annot.llm import brown_lm
from annot.llm.brown_lm import MIXES, SMOOTHS, class_terms, exchange_clusters, keys_of, mixing_weights, score_texts, words_of

from .cases import crowded, odd_rows, table, words


def tokens_of(text):
    return [*words_of(text), b""]


def plain_model(train, core_size, classes, rounds=2):
    """The model by loops over tokens; only the exchange and the choice of weights are shared, which have tests of their own."""
    counts = Counter(w for t in train for w in tokens_of(t))
    core = sorted((w for w in counts if w), key=lambda w: (-counts[w], -int(keys_of([w])[0][0])))[:core_size]
    unit = {b"": 0, **{w: i + 1 for i, w in enumerate(core)}}
    rest = len(core) + 1
    pairs = np.zeros((rest + 1, rest + 1))
    for t in train:
        before = 0
        for w in tokens_of(t):
            pairs[before, unit.get(w, rest)] += 1
            before = unit.get(w, rest)
    cls = exchange_clusters(pairs, classes, rest=True)
    word_class = {w: int(cls[u]) for w, u in unit.items()}
    for _ in range(rounds):
        now = dict(word_class)
        table = np.zeros((classes + 1, classes + 1))
        around = {}
        for t in train:
            tokens = [b"", *tokens_of(t)]
            for k in range(1, len(tokens)):
                table[now.get(tokens[k - 1], classes), now.get(tokens[k], classes)] += 1
                if tokens[k] not in unit:
                    around.setdefault(tokens[k], []).append((now.get(tokens[k - 1], classes), now.get(tokens[k + 1], classes)))
        total, rows, cols = table.sum() + 1, table.sum(1) + 1, table.sum(0) + 1

        def growth(a, b):
            chance = rows[a] * cols[b] / total
            half = 0.5 * min(chance, 1) + 1e-9
            return math.log((table[a, b] + half) / (chance + half))

        for w, seen in around.items():
            gains = [sum(growth(a, b) + growth(b, z) for a, z in seen) for b in range(1, classes)]
            word_class[w] = 1 + max(range(classes - 1), key=lambda b: (round(gains[b], 9), -b))
    steps = np.zeros((classes, classes))
    for t in train:
        before = 0
        for w in tokens_of(t):
            steps[before, word_class[w]] += 1
            before = word_class[w]
    return counts, word_class, steps


def plain(train, texts, core_size, classes):
    counts, word_class, steps = plain_model(train, core_size, classes)
    n, v = sum(counts.values()), len(counts)
    kinds, once = np.zeros(classes), np.zeros(classes)
    for w, c in word_class.items():
        kinds[c] += 1
        once[c] += bool(w) and counts[w] == 1
    mix, smooth = mixing_weights(steps, kinds, once, n, v)
    tokens = steps.sum(0)
    unseen = [0 if c == 0 else min((once[c] + 0.5) / (tokens[c] + 1), 0.99) for c in range(classes)]
    rare = min((sum(once) + 0.5) / (n + 1), 0.99)
    start = [(tokens[c] + 1) / (n + classes) for c in range(classes)]
    mass = sum(s * u for s, u in zip(start, unseen))

    def step(a, c):
        if a is None:  # after an unknown word
            return sum(start[k] * unseen[k] / mass * step(k, c) for k in range(classes))
        return (steps[a, c] + smooth * start[c]) / (steps[a].sum() + smooth)

    out = []
    for t in texts:
        before, base, score = 0, 0.0, 0.0
        for w in tokens_of(t):
            c = word_class.get(w)
            if c is None:
                p = mix * sum(step(before, k) * unseen[k] for k in range(classes)) + (1 - mix) * rare
            else:
                p = (counts[w] + 1) * (mix * step(before, c) * (1 - unseen[c]) / (tokens[c] + kinds[c]) + (1 - mix) * (1 - rare) / (n + v))
            base += math.log10((counts[w] + 1) / (n + v + 1))
            score += math.log10(p)
            before = c
        out.append((len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), n, round(base, 6), round(score, 6)))
    return out


def found(df):
    return sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


def test_scores_equal_a_plain_version(spark):
    rng = random.Random(7)
    heads, tails = [f"{a}la" for a in "abcdefgh"], [f"{a}mo" for a in "abcdefgh"]
    rare = [f"x{i}" for i in range(40)]

    def text():
        return " ".join(w for _ in range(rng.randint(1, 30)) for w in (rng.choice(heads), rng.choice(rare) if rng.random() < 0.2 else rng.choice(tails)))

    train = [(i, text()) for i in range(120)]
    rows = [*train[:40], *odd_rows(), (77, "ala x3 never x5 x6 seen"), (78, "never")]
    want = sorted(plain([t for _, t in train], [t for _, t in rows], 10, 6))
    # All words at hand, neighbours of some added up beforehand; nearly none added up.
    for middle in (16_384, 5):
        assert found(score_texts(crowded(table(spark, rows)), table(spark, train), classes=6, core=10, middle=middle)) == want
    # A condition on the rows themselves.
    both = [(i, t) for i, (_, t) in enumerate(train)]
    got = score_texts(table(spark, both), F.col("doc_id") % 3 == 0, classes=6, core=10)
    assert found(got) == sorted(plain([t for i, t in both if i % 3 == 0], [t for _, t in both], 10, 6))


def test_words_in_like_places_share_classes_and_help(spark):
    """Rare words go where their neighbours say; held-out texts are likelier than by the base model."""
    rng = random.Random(3)
    kinds = [[f"{k}{i}" for i in range(60)] for k in "pqr"]
    text = lambda: " ".join(rng.choice(kinds[i % 3]) for i in range(rng.randint(9, 60)))
    train = [text() for _ in range(150)]
    _, word_class, _ = plain_model(train, 30, 5)
    sets = [{word_class[w.encode()] for w in k if w.encode() in word_class} for k in kinds]
    assert all(len(s) <= 2 for s in sets) and not sets[0] & sets[1] and not sets[1] & sets[2] and not sets[0] & sets[2]
    got = score_texts(table(spark, [(i, text()) for i in range(40)]), table(spark, list(enumerate(train))), classes=5, core=30).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.3 * sum(r.n_tokens for r in got)


def test_words_that_are_not_near_count_and_are_placed_as_others(spark):
    """With few words at hand only the classes of their neighbours in the second round may differ: with one round nothing does."""
    rng = random.Random(11)
    train = [(i, " ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(rng.randint(0, 30)))) for i in range(150)]
    rows = [*train[:30], *odd_rows(), (900, "w1 unheard w2 w90 unheard of")]
    want = found(score_texts(table(spark, rows), table(spark, train), classes=5, core=6, rounds=1))
    for near, middle in ((20, 4), (0, 16_384), (40, 0)):
        assert found(score_texts(table(spark, rows), table(spark, train), classes=5, core=6, rounds=1, near=near, middle=middle)) == want


def test_a_second_seed_is_taken_when_two_words_share_a_key(spark, monkeypatch):
    real = brown_lm._count_words

    def clashing(seed):
        def run(batches):
            import pyarrow as pa

            for b in real(seed)(batches):
                key = b["key"] if seed else pa.array([-7] * b.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([key, b["check"], b["c"]], names=["key", "check", "c"])

        return run

    monkeypatch.setattr(brown_lm, "_count_words", clashing)
    counted, n, v, seed = brown_lm.count_words(table(spark, [(1, "a b a")]).selectExpr("text", "true as learn"))
    assert (n, v, seed) == (4, 3, 1) and sorted(r.c for r in counted.collect()) == [1, 1, 2]


def test_probabilities_add_up_after_each_class_and_after_unknown_words():
    rng = np.random.default_rng(1)
    steps = rng.integers(0, 90, (7, 7)).astype(float)
    kinds = rng.integers(1, 9, 7)
    once = np.minimum(kinds, rng.integers(0, 5, 7))
    n, v = int(steps.sum()), int(kinds.sum())
    terms = 10 ** class_terms(steps, kinds, once, n, v)
    assert np.allclose((terms[:, :-1] * (steps.sum(0) + kinds)).sum(1) + terms[:, -1], 1)


def test_weights_follow_how_much_classes_tell():
    kinds, once = np.array([1, 20, 20, 20]), np.zeros(4)
    strict = np.array([[0, 50, 0, 0], [0, 0, 900, 0], [0, 0, 0, 900], [50, 850, 0, 0]], float)
    loose = np.outer(strict.sum(1), strict.sum(0)) / strict.sum()
    (_, tight), (_, wide) = (mixing_weights(t, kinds, once, int(t.sum()), 61) for t in (strict, loose))
    assert tight < wide and tight in SMOOTHS and mixing_weights(strict, kinds, once, 2750, 61)[0] == max(MIXES)


def likelihood(pairs, cls, classes):
    member = np.zeros((len(cls), classes))
    member[np.arange(len(cls)), cls] = 1
    table = member.T @ pairs @ member
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return f(table) - f(table.sum(1)) - f(table.sum(0))


def test_exchange_ends_where_no_move_helps():
    n, rng = 20, np.random.default_rng(3)
    pairs = np.zeros((n, n))
    for a in range(1, n):
        for b in range(1, n):
            if a % 2 != b % 2:
                pairs[a, b] = rng.integers(1, 30)
    cls = exchange_clusters(pairs, 4)
    assert not {cls[i] for i in range(1, n, 2)} & {cls[i] for i in range(2, n, 2)}
    best = likelihood(pairs, cls, 4)
    for u in range(1, n):
        for c in range(1, 4):
            moved = cls.copy()
            moved[u] = c
            assert likelihood(pairs, moved, 4) <= best + 1e-6
    apart = exchange_clusters(pairs, 4, rest=True)
    assert apart[-1] == 4 and max(apart[:-1]) < 4 and apart[0] == 0


def test_held_out_perplexity_stays_below_its_bound(spark):
    """1,088 on the given table, where the base score has 11,658."""
    import os

    import pytest

    folder = "/root/testdata/sf0.01"
    if not os.path.exists(folder):
        pytest.skip("no given tables")
    got = brown_lm.op5_class_lm_scores(spark, folder).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).head()
    assert 10 ** -got[0] < 1_300 and 10 ** -got[1] > 11_000


def test_empty_tables(spark):
    assert score_texts(table(spark, []), table(spark, [])).count() == 0
    got = score_texts(table(spark, [(1, "a b")]), table(spark, [])).collect()[0]
    assert got.n_known == 0 and got.base_score == 0
