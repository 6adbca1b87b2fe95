import random

import pytest
from made import words
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, nulls, empty and long texts, repeated rows, ties, and odd characters."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 120)) for _ in range(60)]
    out = [(i, t, "en" if i % 3 else "de", f"s{i % 4}") for i, t in enumerate(base)]
    n = len(out)
    for k in range(12):  # exact copies of one text, and edited ones
        out.append((n + k, base[5] + (" tail" if k % 3 == 0 else ""), "en", "s0"))
    n = len(out)
    long = words(rng, 400)
    for k in range(10):
        w = long.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(99))
        out.append((n + k, " ".join(w), "de", None))
    n = len(out)
    out += [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, " \n\t ", "en", "s1"), (n + 3, "one two", "en", "s2"), (n + 4, "One  TWO", "de", "s2"), (n + 5, "x" * 30000, "en", "s3"), (n + 6, "çé 漢字 \U0001f600 straße İ don't I'll  we go\n\n", "fr", "s3"), (n + 7, "12 34 !!", "fr", "s3"), (n + 8, words(rng, 9000), "de", "s1"), (None, base[7], "en", "s1")]
    out.append(out[3])  # a repeated row
    return [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows, with extra columns whose names clash with what operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("size", "score", "node", "rid", "h", "value", "key", "bucket", "rank", "page", "kept", "salt"):
        df = df.withColumn(name, F.lit("extra"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
