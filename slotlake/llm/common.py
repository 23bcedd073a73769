"""Small helpers of the operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from slotlake.session import ship_package as ship_package

def arrow_schema(schema: StructType | str) -> pa.Schema:
    """The Arrow schema of a Spark schema or DDL text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def extended(schema: StructType, ddl: str) -> StructType:
    """The schema with the columns of a DDL text behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
