import pytest
from pyspark.sql import types as T

WORDS = "the of and to in is that with for was on are as by from this at or it an lorem ipsum dolor sit amet elit sed do magna".split()


def prose(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(90)) if r.random() < 0.4 else "") for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (doc_id, text[, source]) rows to documents, with more columns
    whose names operators use themselves."""

    def make(rows, **more):
        kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(k, T.StringType()) for k in more]])
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "s", "en", len(r[1] or ""), *more.values()) for r in rows], kind)

    return make


#: Nulls in any column, empty and blank texts, ties and repeated rows.
ODD = [(1, None, None), (2, "", "a"), (3, "  \t\n ", "a"), (None, "no id here", "b"), (None, None, None), (4, "tie tie tie", "a"), (4, "tie tie tie", "a"), (5, "ÀÉ ümlaut 社安 text", None), (6, "x" * 300_000, "b"), (7, "word " * 60_000, "b")]
