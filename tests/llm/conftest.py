import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    def make(texts, first=0, source="s"):
        rows = [(first + k, t, "en", source, None if t is None else len(t)) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENT)

    return make
