import pandas as pd
import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from a list of texts (or (id, text) pairs), with extra columns whose names clash with inner ones."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("t", T.StringType()), T.StructField("pos", T.IntegerType()),
                           T.StructField("spans", T.StringType()), T.StructField("row", T.StringType())])

    def make(texts, parts=3):
        rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
        return spark.createDataFrame([(i, x, "x", 1, None, "r") for i, x in rows], schema).repartition(parts)
    return make


@pytest.fixture(scope="session")
def documents():
    return pd.read_parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def proto():
    import public_tokenizers
    return lambda name: open(public_tokenizers.path(name), "rb").read()


def table(df, key="doc_id"):
    """Rows of a result as {id: row}."""
    return {r[key]: r for r in df.collect()}
