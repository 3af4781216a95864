import datetime

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 997}" for i in range(30_000))
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.DateType()),
])
PROSE = "the quick brown fox jumps over the lazy dog and runs home again before night falls on the hill "

ROWS = [
    (0, None, "en", "a", 0), (1, "", "en", "a", 0), (2, " \t\n ", None, None, 4), (3, "one", "en", None, 3),
    (4, PROSE, "en", "a", None), (5, PROSE.upper(), "en", "b", 96), (6, PROSE.replace(" ", "\n"), "de", "b", 96),
    (7, PROSE, "en", "a", 96), (7, PROSE, "en", "a", 96), (8, LONG, "fr", "c", len(LONG)), (None, PROSE, "en", "a", 1),
    (9, "ünïcödé 日本語 😀 words", "fr", "ç", 20), (10, "12 34 !!", "en", "c", 8), (11, "line\nline\nother line\n\nline", "en", "c", 25),
    (12, LONG + " tail", "fr", "c", None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeats, clashing names."""
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(*r, "x", None, day) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
