import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


def words(seed: int, n: int) -> str:
    import numpy as np

    return " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, short, repeated and very long texts, ties and repeated ids."""
    base = words(1, 120)
    long_ = words(2, 60000)
    rows = [
        (1, base, "en", "s0", len(base)), (2, base, "en", "s0", len(base)), (3, base + " tail", None, None, None),
        (3, base + " tail", None, None, None), (4, None, "en", "s1", 0), (5, "", "en", "s1", 0), (6, " \t\n ", "de", "s1", 4),
        (7, "one two", "en", "s1", 7), (8, "one two", "en", "s1", 7), (None, base, "en", "s0", 1), (None, None, None, None, None),
        (9, long_, "en", "s2", len(long_)), (10, "Mail a.b@c.example.org now. Again: +1 (555) 010-9999\nsame line\nsame line", "fr", "s2", 70),
        (11, words(3, 40) + " " + words(1, 60), "en", "s2", 1), (12, "x" * 50000, "en", "s2", 50000), (13, "é\u00a0ÜBER straße 日本", "de", "s3", 1),
        (3, words(4, 30), "en", "s3", 2),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def write(df, path, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
