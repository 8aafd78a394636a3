import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash with those the operators add."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", 0, "clash") for r in rows]
        schema = T.StructType([*DOCS.fields, T.StructField("size", T.StringType())])
        return spark.createDataFrame(full, schema)

    return make
