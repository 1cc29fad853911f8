"""Quality scores by Bradley-Terry pairwise ranking.

Each text becomes a short vector of shape features (shares of kinds of characters, words and lines). Pairs of a good and
a bad document are preferences: the probability that a document beats another is logistic in the difference of their
scores, which are linear in the features. The weights minimise the logistic loss over the differences. The cut between
good and bad is a quantile of the scores: the one, of a grid, that tells the labelled documents apart best.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold_of, labels, seeded, written

#: The fit uses at most so many labelled documents, those with the lowest seeded hash, and so many pairs of them.
FIT_ROWS = 20_000
FIT_PAIRS = 60_000
SEED = 5
RIDGE = 1e-3

#: Kinds of bytes whose shares are features.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t", "line": b"\n\r", "stop": b".", "comma": b",;:", "shout": b"!?",
    "quote": b"\"'`", "bar": b"|", "star": b"*", "hash": b"#", "money": b"$%&", "bracket": b"()[]{}<>", "slash": b"/\\", "join": b"-_+=~^@", "high": bytes(range(128, 256)), "control": bytes([*range(9), 11, 12, *range(14, 32), 127]),
}
SHAPES = ["chars", "words", "word_length", "long_words", "distinct_words", "top_word", "upper_words", "marked_words", "repeated_lines", "line_length", "repeated_halves"]
NAMES = [*KINDS, *SHAPES]
_kind = np.full(256, len(KINDS), np.uint8)
for _i, _bytes in enumerate(KINDS.values()):
    _kind[list(_bytes)] = _i
_UPPER = re.compile(rb"[A-Z\xc3]{2,}")


def features(text: str | None) -> list[float]:
    """The features of a text, each between 0 and about 1; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(NAMES)
    shares = np.bincount(_kind[np.frombuffer(raw, np.uint8)], minlength=len(KINDS) + 1)[:-1] / len(raw)
    words = raw.split()
    n = max(1, len(words))
    different: dict[bytes, int] = {}
    for w in words:
        different[w] = different.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper = sum(k for w, k in different.items() if w.upper() == w and w.lower() != w and len(w) > 1)
    marked = sum(k for w, k in different.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:")
    middle = [b" ".join(words[i : i + 4]) for i in range(0, len(words) - 3, 4)]
    shapes = [
        np.log1p(len(raw)) / 12, np.log1p(len(words)) / 10, min(1.0, len(raw) / n / 20), sum(k for w, k in different.items() if len(w) > 16) / n, len(different) / n, max(different.values(), default=0) / n,
        upper / n, marked / n, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(raw) / max(1, len(lines)) / 1000), 1 - len(set(middle)) / max(1, len(middle)),
    ]
    return [*np.sqrt(shares).tolist(), *(float(x) for x in shapes)]


def _featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = pd.DataFrame([features(t) for t in batch["text"]], columns=[f"f_{n}" for n in NAMES], dtype="float64")
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def text_features(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and a column f_<name> for each feature, over whole texts."""
    id_type = df.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, " + ", ".join(f"f_{n} double" for n in NAMES)
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(_featurise, schema)


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, pairs: int = FIT_PAIRS, ridge: float = RIDGE, steps: int = 30) -> tuple[np.ndarray, float, float]:
    """Weights, cut and scale of scores x @ weights. y: 1 for good rows and 0 for bad ones. Without both, weights are 0."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1]), 0.0, 1.0
    rng = np.random.default_rng(SEED)
    spread = x.std(0)
    scaled = np.where(spread > 1e-9, x / np.where(spread > 1e-9, spread, 1), 0)
    diff = scaled[rng.choice(good, pairs)] - scaled[rng.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method; all pairs have the outcome 1
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w)), diff.T @ (1 - p) / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    weights = np.where(spread > 1e-9, w / np.where(spread > 1e-9, spread, 1), 0)
    score = x @ weights
    cuts = np.unique(np.quantile(score, np.linspace(0, 1, 1001)))
    order = np.argsort(score)
    ranked, below_bad = score[order], np.concatenate([[0], np.cumsum(y[order] == 0)])
    at = np.searchsorted(ranked, cuts)
    right = below_bad[at] + (y == 1).sum() - (at - below_bad[at])
    best = np.flatnonzero(right == right.max())
    k = best[len(best) // 2]
    cut = float(cuts[k] if k == 0 else (cuts[k] + ranked[max(0, at[k] - 1)]) / 2)
    return weights, cut, float(max(score.std() / 4, 1e-6))


def labelled(marked: DataFrame, fit_rows: int) -> DataFrame:
    """doc_id and label of the rows to fit on: of several labels of a document, the largest."""
    return marked.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(seeded(F.lit(SEED), F.col("doc_id")), "doc_id").limit(fit_rows)


def fit_quality(feats: DataFrame, marked: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[np.ndarray, float, float]:
    """The model from feats and marked (doc_id, label): fitted on at most fit_rows rows, which are brought to the driver."""
    got = feats.join(labelled(marked, fit_rows), "doc_id").drop("doc_id").toArrow().to_pandas()
    return fit_bradley_terry(got[[f"f_{n}" for n in NAMES]].to_numpy(float), got["label"].to_numpy())


def score_column(model: tuple[np.ndarray, float, float]):
    weights, cut, scale = model
    total = sum((F.col(f"f_{n}") * float(w) for n, w in zip(NAMES, weights, strict=True)), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total - float(cut)) / float(scale)))


def quality_scores(df: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, predicted for each row of df.

    marked: doc_id and label (1 good, 0 bad; nulls are passed over) to learn from. Null texts score as empty ones. Rows
    with equal texts have equal scores. Without labels of both kinds every score is 0.5. An empty table gives an empty
    table; extra columns are ignored.
    """
    feats = written(text_features(df, doc_id, text), "quality-features")
    score = score_column(fit_quality(feats, marked, fit_rows))
    return feats.select("doc_id", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_low_quality(df: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of df that the classifier, fitted on marked as in quality_scores, doesn't reject: those that score 0.5 or more."""
    rows = labelled(marked, fit_rows)
    sample = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(rows.select("doc_id")), "doc_id")  # at most fit_rows ids
    weights, cut, _ = fit_quality(text_features(sample), marked, fit_rows)

    @F.pandas_udf("double")
    def above(texts: pd.Series) -> pd.Series:
        return pd.Series([float(np.dot(features(t), weights)) - cut for t in texts], dtype="float64")

    return df.where(above(F.coalesce(F.col(text), F.lit(""))) >= 0)


def op1_quality_scores(spark, sf_dir: str) -> DataFrame:
    marked = labels(spark, sf_dir).where(fold_of(F.col("doc_id"), 3) != 1).select("doc_id", F.col("quality").alias("label"))
    out = quality_scores(documents(spark, sf_dir), marked)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
