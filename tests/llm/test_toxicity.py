import random

import numpy as np

from annot.llm.toxicity import fit_noisy_or, sentences, toxicity_scores

from .cases import crowded, odd_rows, table, words


def test_finds_documents_and_sentences(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        parts = [words(rng, rng.randint(3, 12)) for _ in range(rng.randint(1, 12))]
        toxic = i % 5 == 0
        if toxic:
            k = rng.randrange(len(parts))
            parts[k] += " " + rng.choice(["vile", "nasty", "foul"])
        rows.append((i, ". ".join(parts) + "."))
        labels.append((i, int(toxic)))
    marked = spark.createDataFrame(labels[:300] + [(3, None), (None, 1)], "doc_id long, label int")
    got = {r.doc_id: r for r in toxicity_scores(crowded(table(spark, rows)), marked).collect()}
    assert np.mean([got[i].predicted == y for i, y in labels[300:]]) > 0.97
    for i, y in labels[300:]:
        if y and got[i].predicted:
            place = rows[i][1][got[i].sentence_start : got[i].sentence_end]
            assert any(w in place for w in ("vile", "nasty", "foul"))


def test_noisy_or_gradient_raises_the_likelihood():
    label, n = np.array([1, 1, 0, 0, 0, 1]), np.array([3, 2, 4, 1, 2, 5])
    w, b = fit_noisy_or(label, n, [[0], [1], [], [0], [], [2]], [[0], [0], [], [1], [], [0]], 2)
    assert w[0] + b > 1 and w[1] + b < 0


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = odd_rows()
    got = toxicity_scores(crowded(table(spark, rows)), none).collect()
    assert len(got) == len(rows)
    assert all(r.score == 0 for r in got if r.doc_id in (1, 2))
    assert toxicity_scores(table(spark, []), none).count() == 0
    assert sentences("a. b\nc!") == [(0, 1), (2, 4), (5, 6)]


def test_odd_rows_with_labels(spark):
    """Null, empty, repeated, very long and non-ASCII texts meet a model that was trained, and clashing columns."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(100, 500):
        toxic = i % 4 == 0
        rows.append((i, words(rng, 20) + (". foul vile. " if toxic else ". ") + words(rng, 9)))
        labels.append((i, int(toxic)))
    odd = odd_rows() + [(600, "foul vile"), (600, "foul vile"), (601, words(rng, 30_000) + ". foul vile thing. " + words(rng, 30_000)), (602, "FOUL VILE \u0130\u00df \U0001f642"), (None, "foul vile")]
    marked = spark.createDataFrame([*labels, (1, 0), (2, 1), (4, 0), (None, 1), (600, None)], "doc_id long, label int")
    got = toxicity_scores(crowded(table(spark, rows + odd)), marked).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].score == by[2][0].score == 0
    assert len({(r.score, r.predicted) for r in by[600]}) == 1 and by[600][0].predicted == 1
    assert by[601][0].predicted == by[602][0].predicted == 1 and by[None][0].score in {by[600][0].score, min(r.score for r in by[None])}
    assert all(r.predicted == 0 for r in by[10] + by[9])
