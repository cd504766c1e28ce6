import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def small(spark):
    """Rows that break careless code: nulls, empty and long texts, repeats,
    and columns whose names clash with those that operators make."""
    long = "word " * 40_000
    rows = [(1, "Hello there, this is a plain text of some words", "en", 5), (1, "Hello there, this is a plain text of some words", "en", 5),
            (2, None, "en", 6), (3, "", None, 7), (None, "a text without id", "en", 8), (4, "   \n\t ", "fr", 9),
            (5, long, "en", 10), (6, "123 456 !!", "en", 11), (7, "Hello there, this is a plain text of some words", None, None)]
    cols = "doc_id long, text string, lang string, score long"
    df = spark.createDataFrame(rows, cols)
    for c in ("shard", "key", "node", "h", "id", "v", "component_id", "n", "_text", "windows", "bad"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(small):
    return small.limit(0)
