import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves, and one that differs by case alone
        T.StructField("id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("k1", T.StringType()),
        T.StructField("TEXT", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with columns that clash with the operators' own."""

    def make(rows):
        filled = [(i, t, "en", None, None if t is None else len(t), "x", None, 1.0, "k", "upper") for i, t in rows]
        return spark.createDataFrame(filled, DOCS)

    return make
