"""Small documents for the operators: every odd case, and texts with structure."""

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows():
    rng = random.Random(5)
    long = words(rng, 30_000)
    same = words(rng, 120)
    rows = [(1, None), (2, ""), (3, "   \n\t "), (4, "x"), (5, long), (6, same), (7, same), (8, same), (8, same), (None, same), (None, None), (9, "Ünï çødé 漢字 🙂 é"), (10, "a\n\n\nb\n"), (11, same + " tail")]
    return [(d, t, None if k % 3 else "en", "s", None) for k, (d, t) in enumerate(rows)]


def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


def with_clashes(df):
    """The same rows and columns that operators might use themselves."""
    from pyspark.sql import functions as F

    for name in ("row", "fp", "tokens", "cell", "size", "key", "shard", "digest", "start", "end", "score", "n_lines", "fingerprint", "component_id", "template", "unit", "best", "__row", "__doc", "__gone", "__cut", "__cell", "__text", "__n_lines", "__own"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
