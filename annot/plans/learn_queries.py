"""Queries of classifiers and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annot.operators import classify

from .base import registry

QUERIES, query = registry()
_MD5 = "md5('42|' || vec_id)"


@query(f"SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY {_MD5}, vec_id) - 1) % 3 AS fold FROM embeddings")
def folds(t):
    return classify.stratified_folds(t.embeddings.select("vec_id", "label"), "label", "vec_id").select("vec_id", "fold")


@query(f"SELECT vec_id, row_number() OVER (ORDER BY {_MD5}, vec_id) <= ceil(0.2 * (SELECT count(*) FROM embeddings)) AS is_test FROM embeddings")
def holdout(t):
    return classify.holdout_split(t.embeddings.select("vec_id"), "vec_id").select("vec_id", "is_test")


def told(t):
    return t.embeddings.select("vec_id", F.col("label").cast("int").alias("label"), (F.col("vec_id") % 10).cast("int").alias("guess"))


@query("SELECT label AS class, " + ", ".join(f"count(*) FILTER (vec_id % 10 = {c}) AS p_{c}" for c in range(10)) + " FROM embeddings GROUP BY 1 UNION ALL SELECT 10, " + ", ".join("0" for _ in range(10)))
def confusion(t):
    out = classify.confusion_matrix(told(t), "label", "guess", [*range(11)])
    return out.drop("p_10")


@query("""WITH c AS (SELECT unnest(range(10)) AS class), s AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (vec_id % 10 = class) AS told, count(*) FILTER (label = class AND vec_id % 10 = class) AS hit FROM embeddings, c GROUP BY 1)
 SELECT class, round_even(coalesce(hit / nullif(told, 0)::DOUBLE, 0), 3) AS precision, round_even(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 3) AS recall, round_even(coalesce(2.0::DOUBLE * hit / nullif(told + support, 0), 0), 3) AS f1_score, support FROM s""")
def per_class_metrics(t):
    return classify.per_class_metrics(told(t), "label", "guess")


@query("""WITH c AS (SELECT unnest(range(12))::INT AS class), s AS (SELECT class, count(*) FILTER (label = class) AS support, count(*) FILTER (vec_id % 10 = class) AS told, count(*) FILTER (label = class AND vec_id % 10 = class) AS hit FROM embeddings, c GROUP BY 1)
 SELECT class, round_even(coalesce(hit / nullif(told, 0)::DOUBLE, 0), 3) AS precision, round_even(coalesce(hit / nullif(support, 0)::DOUBLE, 0), 3) AS recall, round_even(coalesce(2.0::DOUBLE * hit / nullif(told + support, 0), 0), 3) AS f1_score, support FROM s""")
def per_class_metrics_all(t):
    """Classes 10 and 11 are no row's label or prediction."""
    return classify.per_class_metrics(told(t), "label", "guess", [*range(12)])


@query("SELECT avg((label = vec_id % 10)::INT) AS accuracy FROM embeddings")
def accuracy(t):
    return classify.accuracy(told(t), "label", "guess")


@query("SELECT DISTINCT c AS class FROM (SELECT unnest([label, vec_id % 10]) AS c FROM embeddings)")
def active_classes(t):
    return classify.active_classes(told(t), "label", "guess")


@query("SELECT event_id, (dense_rank() OVER (ORDER BY event_type) - 1)::DOUBLE AS label_index FROM events")
def index_labels(t):
    return classify.index_labels(t.events.select("event_id", "event_type"), "event_type").select("event_id", "label_index")


@query("SELECT count(*) AS n, count(DISTINCT label) AS n_classes, max(len(embedding)) AS max_dim, count(DISTINCT label) * max(len(embedding)) AS n_coefficients, 1.0::DOUBLE / count(DISTINCT label) AS guess FROM embeddings")
def dataset_summary(t):
    return classify.dataset_summary(t.embeddings, "label", "embedding")


@query("""WITH h AS (SELECT label, vec_id % 10 AS p, vec_id % 7 AS q FROM embeddings) SELECT label AS class, round_even(count(*) FILTER (p = label) / count(*)::DOUBLE, 3) AS a, round_even(count(*) FILTER (q = label) / count(*)::DOUBLE, 3) AS b FROM h GROUP BY 1""")
def metric_matrix(t):
    rows = t.embeddings.select(F.col("label").cast("int").alias("label"), (F.col("vec_id") % 10).cast("int").alias("a"), (F.col("vec_id") % 7).cast("int").alias("b"))
    both = [classify.per_class_metrics(rows, "label", c).withColumn("condition", F.lit(c)) for c in "ab"]
    return classify.metric_matrix(both[0].unionByName(both[1]), "recall", ["a", "b"])


@query()
def softmax_cv(t):
    return classify.cross_validate(classify.index_labels(t.embeddings, "label"), "label_index", "vec_id")


@query()
def compare_conditions(t):
    rows = classify.index_labels(t.embeddings, "label")
    half = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    metrics, _ = classify.compare_conditions({"whole": rows, "half": half, "none": None}, "label_index", "vec_id")
    return classify.metric_matrix(metrics, "f1_score", ["whole", "half"])


@query()
def compare_conditions_summary(t):
    rows = classify.index_labels(t.embeddings, "label")
    half = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    return classify.compare_conditions({"whole": rows, "half": half}, "label_index", "vec_id")[1]


def _balance(model, train, **more):
    """A model's rows by class as its probabilities tell them, and whether its loss is level there."""
    out = classify.fit_balance(model, train)
    return out.select(*[F.lit(v).alias(k) for k, v in more.items()], "class", F.round("expected").cast("long").alias("n"), (F.col("slope") < 1e-4).alias("level"))


_LABELS = "(SELECT vec_id, label, (dense_rank() OVER (ORDER BY label::VARCHAR) - 1)::INT AS class FROM embeddings)"


@query(f"""WITH f AS (SELECT class, (row_number() OVER (PARTITION BY label ORDER BY {_MD5}, vec_id) - 1) % 3 AS own FROM {_LABELS})
 SELECT fold, class, count(*) AS n, true AS level FROM f, (SELECT unnest([0, 1, 2])::INT AS fold) WHERE own <> fold GROUP BY 1, 2""")
def softmax_fold_fits(t):
    """At the minimum of its loss a fold's model expects as many rows of each class as the other folds have."""
    models = classify.fold_models(classify.index_labels(t.embeddings, "label"), "label_index", "vec_id", tol=1e-10)
    return reduce(DataFrame.unionByName, [_balance(model, train, fold=f) for f, (model, train, _) in enumerate(models)])


@query(f"""WITH f AS (SELECT class, row_number() OVER (ORDER BY {_MD5}, vec_id) <= ceil(0.2 * (SELECT count(*) FROM embeddings)) AS is_test FROM {_LABELS})
 SELECT condition, class, count(*) AS n, true AS level FROM f, (SELECT unnest(['whole', 'half']) AS condition) WHERE NOT is_test GROUP BY 1, 2""")
def softmax_condition_fits(t):
    """The same of the models that compare_conditions fits."""
    rows = classify.index_labels(t.embeddings, "label")
    half = rows.withColumn("embedding", F.slice("embedding", 1, 32))
    models = classify.condition_models({"whole": rows, "half": half, "none": None}, "vec_id", "label_index", tol=1e-10)
    return reduce(DataFrame.unionByName, [_balance(model, train, condition=name) for name, model, train, _ in models])


@query()
def predict(t):
    """Predictions for the held-out fifth by a model of the other rows."""
    rows = classify.holdout_split(classify.index_labels(t.embeddings, "label"), "vec_id")
    model = classify.fit_softmax(rows.where(~F.col("is_test")))
    return classify.predict(model, rows.where("is_test")).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))
