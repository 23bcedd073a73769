import pytest
from llm_rows import CLASHING, SCHEMA, edge_rows
from pyspark.sql import functions as F

from slotlake.llm.common import ship_package


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_package(spark)


@pytest.fixture
def edge_docs(spark):
    df = spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
