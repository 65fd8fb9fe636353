"""CSV tables: bad rows are dropped, exactly the given path is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a schema in one pass; without, the types are inferred in a pass before."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)
