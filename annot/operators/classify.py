"""Softmax classifiers on vectors, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annot.operators.combine import reindex
from annot.operators.dedup import with_ordinal
from annot.operators.quantiles import beside


def _order(key: str, seed: int):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))


def index_labels(df: DataFrame, column: str, output: str = "label_index") -> DataFrame:
    """Adds the place of each label in alphabetical order."""
    text = df.withColumn("_label", F.col(column).cast("string"))
    return StringIndexer(inputCol="_label", outputCol=output, stringOrderType="alphabetAsc").fit(text).transform(text).drop("_label")


def holdout_split(df: DataFrame, key: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: true for the ceil(frac * n) rows that are first by a seeded hash of the key."""
    placed = with_ordinal(df.withColumn("_h", _order(key, seed)), ["_h", key], "_place")
    n = placed.agg(F.count(F.lit(1)).alias("_n"))
    return beside(placed, n, []).withColumn("is_test", F.col("_place") <= F.ceil(F.col("_n") * frac)).drop("_h", "_place", "_n")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """Adds fold: each label's rows, in the order of a seeded hash, dealt to k folds in turn.

    Rows are sorted by ranges of (label, hash), and a row's place is its place in all of them less that of its label's
    first, so that a label with many rows is spread over tasks.
    """
    placed = with_ordinal(df.withColumn("_h", _order(key, seed)), [label, "_h", key], "_place")
    first = placed.groupBy(F.col(label).alias("_label")).agg(F.min("_place").alias("_first"))
    joined = placed.join(first, F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn("fold", ((F.col("_place") - F.col("_first")) % k).cast("int")).drop("_h", "_place", "_label", "_first")


def fit_softmax(df: DataFrame, vector: str = "embedding", label: str = "label_index", c: float = 1.0, max_iter: int = 1000, tol: float = 1e-6) -> LogisticRegressionModel:
    """Multinomial logistic regression with an L2 penalty: c times the sum of losses plus half the squared norm."""
    rows = df.select(F.col(label).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n = max(1, rows.count())
    return LogisticRegression(family="multinomial", regParam=1 / (c * n), standardization=False, maxIter=max_iter, tol=tol).fit(rows)


def fit_balance(model: LogisticRegressionModel, df: DataFrame, vector: str = "embedding", label: str = "label_index") -> DataFrame:
    """class, expected, slope: whether a model is the minimum of its loss over the rows that it was fitted on.

    At the minimum each class's probabilities add up to its number of rows, as biases carry no penalty: expected is that sum.
    slope is the largest part of the loss's gradient by a weight of the class, a row: 0 at the minimum. A row of the result
    for each class of the model; what is summed is a row a dimension. Rows without a label or a vector are left out; no rows
    give no classes.
    """
    classes, reg = model.numClasses, model.getRegParam()
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x"))
    told = model.transform(rows.withColumn("features", array_to_vector("x"))).select("y", "x", vector_to_array("probability").alias("p"))
    sums = told.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col("p")[c]).alias(f"p{c}") for c in range(classes)])
    expected = sums.where("rows > 0").select("rows", F.posexplode(F.array(*[f"p{c}" for c in range(classes)])).alias("class", "expected"))
    over = told.select(F.posexplode("x").alias("j", "v"), "y", "p").groupBy("j").agg(*[F.sum(F.col("v") * (F.col("p")[c] - (F.col("y") == c).cast("int"))).alias(f"g{c}") for c in range(classes)])
    weights = df.sparkSession.createDataFrame([(j, [float(w) for w in column]) for j, column in enumerate(model.coefficientMatrix.toArray().T)], "j int, w array<double>")
    over = over.join(weights, "j").select(F.posexplode(F.array(*[F.struct(F.col(f"g{c}").alias("g"), F.col("w")[c].alias("w")) for c in range(classes)])).alias("class", "x"))
    slopes = over.join(expected, "class").groupBy("class", "expected").agg(F.max(F.abs(F.col("x.g") / F.col("rows") + reg * F.col("x.w"))).alias("slope"))
    return slopes.select("class", "expected", "slope")


def predict(model: LogisticRegressionModel, df: DataFrame, vector: str = "embedding") -> DataFrame:
    return model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))).drop("features", "rawPrediction", "probability")


def accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def per_class_metrics(df: DataFrame, label: str, prediction: str, classes: list | None = None) -> DataFrame:
    """class, precision, recall, f1_score (rounded half to even at 3 places, 0 where undefined) and support.

    With classes given, these and no others have a row, zeros if they are neither label nor prediction of any.
    """
    true, told = F.col(label), F.col(prediction)
    pairs = df.groupBy(true.alias("t"), told.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("told"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("told"), F.lit(0).cast("long").alias("hit")))).alias("x"))
    s = long.groupBy(F.col("x.class").alias("class")).agg(*[F.sum(f"x.{c}").alias(c) for c in ("support", "told", "hit")])
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("told") + F.col("support")), F.lit(0.0))
    out = s.select("class", F.bround(ratio("hit", "told"), 3).alias("precision"), F.bround(ratio("hit", "support"), 3).alias("recall"), F.bround(f1, 3).alias("f1_score"), "support")
    return out if classes is None else reindex(out, "class", classes).drop("pos")


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: list) -> DataFrame:
    """A row a class of the fixed grid and a column a predicted class."""
    counts = df.where(F.col(label).isin(classes)).groupBy(F.col(label).alias("class")).agg(*[F.count_if(F.col(prediction) == c).alias(f"p_{c}") for c in classes])
    kind = df.schema[label].dataType.simpleString()
    spine = df.sparkSession.createDataFrame([(c,) for c in classes], f"class {kind}")
    return spine.join(counts, "class", "left").fillna(0)


def active_classes(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Classes that are some row's label or prediction, in order."""
    return df.select(F.explode(F.array(label, prediction)).alias("class")).distinct().orderBy("class")


def fold_models(df: DataFrame, label: str, key: str, vector: str = "embedding", k: int = 3, seed: int = 42, tol: float = 1e-6) -> Iterator[tuple[LogisticRegressionModel, DataFrame, DataFrame]]:
    """For each of k stratified folds the model of the other rows, these, and the fold's."""
    folds = stratified_folds(df, label, key, k, seed)
    for f in range(k):
        train = folds.where(F.col("fold") != f)
        yield fit_softmax(train, vector, label, tol=tol), train, folds.where(F.col("fold") == f)


def cross_validate(df: DataFrame, label: str, key: str, vector: str = "embedding", k: int = 3, seed: int = 42) -> DataFrame:
    """accuracy_mean and accuracy_std (of the population) over k stratified folds."""
    scores = [accuracy(predict(model, test, vector), label, "prediction") for model, _, test in fold_models(df, label, key, vector, k, seed)]
    return reduce(DataFrame.unionByName, scores).agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def condition_models(conditions: dict[str, DataFrame], key: str, label: str, vector: str = "embedding", tol: float = 1e-6) -> Iterator[tuple[str, LogisticRegressionModel, DataFrame, DataFrame]]:
    """For each condition with data its name, the model of four fifths of its rows, these, and the held-out fifth."""
    for name, df in conditions.items():
        if df is None or not df.limit(1).count():
            continue
        split = holdout_split(df, key)
        train = split.where(~F.col("is_test")).drop("is_test")
        yield name, fit_softmax(train, vector, label, tol=tol), train, split.where("is_test")


def compare_conditions(conditions: dict[str, DataFrame], label: str, key: str, vector: str = "embedding", k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Metrics and summary; conditions without data are passed over.

    Metrics: condition, class and metrics on a held-out fifth, for every class that the condition's rows have. Summary:
    condition, cv_mean (accuracy over k folds of the other rows), test_acc and n_test.
    """
    parts, summary = [], []
    for name, model, train, held in condition_models(conditions, key, label, vector):
        told = predict(model, held, vector)
        classes = sorted(r[0] for r in conditions[name].select(F.col(label).cast("double")).distinct().collect() if r[0] is not None)  # as many as the model has
        parts.append(per_class_metrics(told, label, "prediction", classes).withColumn("condition", F.lit(name)))
        test = told.agg(F.avg((F.col(label) == F.col("prediction")).cast("int")).alias("test_acc"), F.count(F.lit(1)).alias("n_test"))
        summary.append(beside(cross_validate(train, label, key, vector, k), test, []).select(F.lit(name).alias("condition"), F.bround("cv_mean", 3).alias("cv_mean"), F.bround("test_acc", 3).alias("test_acc"), "n_test"))
    if not parts:
        raise ValueError("no condition has data")
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, summary)


def metric_matrix(metrics: DataFrame, metric: str, conditions: list[str]) -> DataFrame:
    """class and a column a condition, for classes with support in any of them."""
    return metrics.groupBy("class").agg(F.max("support").alias("_s"), *[F.max(F.when(F.col("condition") == c, F.col(metric))).alias(c) for c in conditions]).where("_s > 0").drop("_s")


def dataset_summary(df: DataFrame, label: str, vector: str) -> DataFrame:
    """n, n_classes, max_dim, the number of coefficients and the accuracy of guessing."""
    out = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("n_classes"), F.max(F.size(vector)).alias("max_dim"))
    return out.withColumn("n_coefficients", F.col("n_classes") * F.col("max_dim")).withColumn("guess", 1.0 / F.col("n_classes"))
