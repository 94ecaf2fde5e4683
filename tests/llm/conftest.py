import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("score", T.StringType()),
                     T.StructField("n", T.LongType()), T.StructField("ids", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with extra columns whose names the operators also use."""
    def make(rows, parts=2):
        return spark.createDataFrame([(i, t, None, "s", 7, "x") for i, t in rows], DOCS).repartition(parts)

    return make
