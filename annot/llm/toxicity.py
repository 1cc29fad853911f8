"""Toxicity by multiple-instance learning: documents are bags of sentences, and only bags have labels.

A sentence's probability is logistic in the words it holds and their beginnings; a document is toxic if any of its sentences is, so its
probability is the noisy-or of theirs. The weights maximise the likelihood of the documents' labels. The same sentence
scores then locate the offending sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold_of, labels, seeded, written

#: The fit uses at most so many labelled documents, those with the lowest seeded hash.
FIT_ROWS = 16_000
#: A word or beginning can have a weight if it is in so many toxic documents of those, and in so many standard deviations
#: more than chance explains. Which of these have one is the fit's choice, by a penalty on the weights' sum.
LEAST_TOXIC, LEAST_Z, PENALTY = 3, 3.0, 3e-5
BEGINNINGS = range(3, 9)
#: Words that a Python worker remembers.
MEMO = 200_000
SEED = 9
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: what stands between stops, exclamation or question marks and line ends."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def parts(word: str) -> list[str]:
    """A word and its beginnings, marked as such."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if k < len(word))]


class Known:
    """The known features of words."""

    def __init__(self, features: dict):
        self.features, self.memo = features, {}

    def of(self, words) -> set[str]:
        """The known features of any of the words."""
        out: set[str] = set()
        for w in words:
            own = self.memo.get(w)
            if own is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                own = self.memo[w] = tuple(f for f in parts(w) if f in self.features)
            if own:
                out.update(own)
        return out


def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        seen: Counter = Counter()
        toxic: Counter = Counter()
        for text, label in zip(batch["text"], batch["label"], strict=True):
            own = {f for w in set(_WORD.findall(text.lower())) for f in parts(w)}
            seen.update(own)
            if label:
                toxic.update(own)
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values()), "n_toxic": [toxic[f] for f in seen]})


def telling_words(sample: DataFrame) -> list[str]:
    """Words found in more toxic documents than chance explains, as many as there are: the sample bounds them."""
    total = sample.agg(F.count(F.lit(1)), F.sum("label")).head()
    n, n_toxic = total[0], total[1] or 0
    if not n_toxic or n_toxic == n:
        return []
    p = n_toxic / n
    counts = sample.mapInPandas(_word_counts, "word string, n long, n_toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    z = (F.col("n_toxic") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    return sorted(r[0] for r in counts.where(F.col("n_toxic") >= LEAST_TOXIC).where(z > LEAST_Z).select("word").collect())


def _bags(words: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(words)
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                spans, hits = sentences(text), []
                low = text.lower()
                if len(low) != len(text):  # a few letters change their length
                    low = "".join(c.lower()[:1] for c in text)
                for k, (a, b) in enumerate(spans):
                    hits += [[k, words[f]] for f in known.of(_WORD.findall(low, a, b))]
                rows.append((int(label), len(spans), [h[0] for h in hits], [h[1] for h in hits]))
            yield pd.DataFrame(rows, columns=["label", "n", "sentence", "word"])

    return run


def fit_noisy_or(label: np.ndarray, n: np.ndarray, sentence: list, word: list, k: int, steps: int = 500, rate: float = 0.05, ridge: float = 3e-4, lasso: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of k words and the bias, by gradient ascent (Adam) on the log-likelihood of the labels.

    Penalties on the weights' squares and on their sum; the second, taken as a proximal step, makes most of them zero.
    Sentences without a known word all have the bias's probability; they enter by their number.
    """
    docs = len(label)
    keys = [np.asarray(s, np.int64) + (np.int64(d) << 32) for d, s in enumerate(sentence)]
    flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
    ids = np.concatenate([np.asarray(w, np.int64) for w in word]) if word else np.empty(0, np.int64)
    rows, inst = np.unique(flat, return_inverse=True)
    bag = (rows >> 32).astype(np.int64)
    plain = n - np.bincount(bag, minlength=docs)
    w, b = np.full(k, 0.5), -6.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = np.clip(np.bincount(inst, w[ids], len(rows)) + b, -30, 30)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        log_none = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), docs) + plain * np.log1p(-p0)
        none = np.exp(np.minimum(log_none, -1e-12))
        pull = np.where(label == 1, none / (1 - none), -1.0)  # the derivative by -log(1 - p) of each sentence
        gz = pull[bag] * p
        g = np.append(np.bincount(ids, gz[inst], k)[:k] / docs - ridge * w, (gz.sum() + (pull * plain).sum() * p0) / docs)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        pace = rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        step = pace * (m / (1 - 0.9**t))
        w, b = w + step[:-1], b + step[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pace[:-1] * lasso, rate), 0)
    return w, float(b)


def fit_toxicity(df: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text", fit_rows: int = FIT_ROWS) -> tuple[dict[str, float], float]:
    """Weight of each word that has one, and the bias. marked: doc_id and label (1 toxic, 0 not)."""
    rows = marked.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(seeded(F.lit(SEED), F.col("doc_id")), "doc_id").limit(fit_rows)
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = written(texts.join(rows.select("doc_id", F.col("label").cast("int").alias("label")), "doc_id").select("text", "label"), "toxic-sample")
    words = {w: i for i, w in enumerate(telling_words(sample))}
    bags = sample.mapInPandas(_bags(words), "label int, n int, sentence array<int>, word array<int>").toArrow().to_pandas()
    if not len(bags):
        return {}, -6.0
    w, b = fit_noisy_or(bags["label"].to_numpy(), bags["n"].to_numpy(), list(bags["sentence"]), list(bags["word"]), len(words))
    return {x: float(w[i]) for x, i in words.items() if w[i]}, b


def _score(weights: dict[str, float], bias: float):
    p0 = 1 / (1 + np.exp(-bias))

    def of(text: str, table: Known) -> tuple:
        spans = sentences(text)
        low = text.lower()
        known = table.of(set(_WORD.findall(low)))
        best, at, log_none = p0 if spans else 0.0, spans[0] if spans else (0, 0), 0.0
        if known:
            if len(low) != len(text):
                low = "".join(c.lower()[:1] for c in text)
            for a, b in spans:
                z = bias + sum(weights[f] for f in sorted(table.of(_WORD.findall(low, a, b))))
                p = 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))
                log_none += np.log1p(-min(p, 1 - 1e-12))
                if p > best:
                    best, at = p, (a, b)
        else:
            log_none = len(spans) * np.log1p(-p0)
        return 1 - float(np.exp(log_none)), float(best), *at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = Known(weights)
        for batch in batches:
            out = pd.DataFrame([of(t, table) for t in batch["text"]], columns=["score", "sentence_score", "sentence_start", "sentence_end"])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return run


def toxicity_scores(df: DataFrame, marked: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, score, predicted and the worst sentence (its score; start and end in code points) for each row of df.

    Null and empty texts have no sentence and score 0. Without labels of both kinds no word tells, and scores are low.
    An empty table gives an empty table; extra columns are ignored.
    """
    model = fit_toxicity(df, marked, doc_id, text, fit_rows)
    id_type = df.schema[doc_id].dataType.simpleString()
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = texts.mapInPandas(_score(*model), f"doc_id {id_type}, score double, sentence_score double, sentence_start int, sentence_end int")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity_scores(spark, sf_dir: str) -> DataFrame:
    marked = labels(spark, sf_dir).where(fold_of(F.col("doc_id"), 4) != 2).select("doc_id", F.col("toxic").alias("label"))
    out = toxicity_scores(documents(spark, sf_dir), marked)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "sentence_score", "sentence_start", "sentence_end")
