import pytest
from pyspark.sql import types as T

LONG_WORD = "x" * 100_000
LONG_TEXT = " ".join(f"w{i % 9973} the" for i in range(40_000))
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row", "key", "size", "tid", "_id", "label", "n"]


def schema(columns=COLUMNS):
    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType()}
    return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns])


def doc(doc_id, text, lang="en", source="a"):
    """A row with further columns whose names clash with those the operators use inside."""
    return (doc_id, text, lang, source, None if text is None else len(text), "r", "k", "s", "t", "i", "l", None)


EDGE_ROWS = [
    doc(1, None), doc(2, ""), doc(3, "one"), doc(4, "the cat sat on the mat with a hat " * 4),
    doc(5, "the cat sat on the mat with a hat " * 4), doc(5, "the cat sat on the mat with a hat " * 4),
    doc(6, LONG_TEXT), doc(7, LONG_WORD, None, None), doc(8, "été à la mer\n\n\nété à la mer\nπ 你好", "fr", None),
    doc(None, "a document without an id but with words in it", None, "b"), doc(None, None, None, None), doc(9, " \t\n\r "),
    doc(10, "tie " * 60, "en", "b"), doc(11, "tie " * 60, "en", "b"), doc(12, "\x1c\x85\xa0 odd blanks   stay in words"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE_ROWS, schema()).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], schema())


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").persist()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
