import pytest
from pyspark.sql import types as T

from graphloom.llm.common import prepare as prepare_llm

LONG = " ".join(f"w{i % 977}x{i}" for i in range(120_000))


@pytest.fixture(autouse=True)
def prepared(spark):
    prepare_llm(spark)


@pytest.fixture
def odd_rows():
    """Nulls in every column, empty, blank, letterless and very long texts, repeated rows, ties."""
    shared = " ".join(f"passage{i}" for i in range(40))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs.", "en"), (2, None, "en"), (3, "", None), (4, " \t\n ", "en"),
        (5, "12345 !!", "en"), (None, "no id here at all", "en"), (6, "x", None), (7, LONG, "en"),
        (8, "The quick brown fox jumps over the lazy dog and runs.", "en"), (8, "The quick brown fox jumps over the lazy dog and runs.", "en"),
        (9, f"begin {shared} end", "de"), (10, f"other {shared} words after", "de"), (10, "same id, another text", "de"),
        (11, "nul\x00 and\x1fodd   spaces 　 café \U0001f600", "fr"),
    ]


@pytest.fixture
def documents(spark, odd_rows):
    """The odd rows with extra columns named as operators name theirs."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    frame = spark.createDataFrame(odd_rows, schema).repartition(3)
    names = ["score", "ids", "fp", "kept", "piece", "length", "base_spans", "sequence_id", "n_words", "name", "h", "part", "number"]
    return frame.selectExpr("*", *[f"'extra' as {n}" for n in names])


@pytest.fixture
def no_documents(documents):
    return documents.where("false")
