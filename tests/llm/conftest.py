import pytest

from edges import CLASHING, EDGE, SCHEMA


@pytest.fixture(scope="session")
def edge(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGE, SCHEMA).withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.withColumns({c: F.lit(f"clash {c}") for c in CLASHING}).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
