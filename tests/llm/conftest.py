import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("score", StringType()), StructField("n_lines", LongType()),
                   StructField("rest", StringType()), StructField("n_chars", LongType()), StructField("ids", StringType()), StructField("key", StringType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (id, text) pairs, with further columns whose names operators use themselves."""
    def make(rows):
        return spark.createDataFrame([(i, t, "s", 7, "r", len(t or ""), "i", "k") for i, t in rows], DOCS)
    return make


LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "without an id"), (5, "same text of some words here"), (6, "same text of some words here"), (6, "same text of some words here"),
       (7, LONG), (8, "ünïcode Äpfel ▁ \U0001f600 text")]


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, a null id, copies, a repeated row and a very long text."""
    return ODD
