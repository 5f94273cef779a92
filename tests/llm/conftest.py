import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """documents from (doc_id, text) or (doc_id, text, source)."""
    def docs(rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows], DOCS)
    return docs


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and long texts, ties, repeated rows, columns with clashing names."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three four"), (6, long), (7, long),
            (7, long), (None, long), (None, None), (8, "ä ö ü ß 漢字 😀 " * 30), (9, "a " * 40), (-3, "same text here " * 6),
            (12, "same text here " * 6)]
    df = make([(i, t, None if k % 4 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)])
    for name in ("size", "n_words", "bucket", "node", "shard", "kept", "_w", "_row", "w", "key", "h", "digest", "mark", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def empty(make):
    return make([])
