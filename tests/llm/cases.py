"""Small tables with the cases that every operator must bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def crowded(df):
    """df with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in ("h", "uid", "name", "size", "score", "label", "digest", "bucket", "id", "piece", "key", "rows")})


def words(rng, n, vocabulary=None):
    vocabulary = vocabulary or [f"w{i}" for i in range(200)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def odd_rows(seed=1):
    """Null, empty and blank texts, a null id, repeated rows, other cases, long and non-ASCII texts."""
    rng = random.Random(seed)
    long = words(rng, 3000)
    return [
        (1, None), (2, ""), (3, "   \n\t"), (4, "One two three four five six."), (4, "One two three four five six."), (5, "one two three four five six."), (6, long), (7, long + " more"), (8, "É" * 50 + " ßü 世界 🙂 " + words(rng, 30)),
        (None, "a text without an id"), (9, "x"), (10, words(rng, 80)), (11, "a  b   c"), (12, "ONE TWO THREE FOUR FIVE SIX."),
    ]
