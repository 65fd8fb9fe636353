"""What the operators share: tables written in the shared folder, and joins that check a size first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.sources.scratch import free, scratch
from loomfeat.sources.scratch import written as _written

__all__ = ["free", "modest", "read", "scratch", "within", "written"]

ARROW_BYTES, ARROW_ROWS = "8m", "2000"  # of an Arrow batch: what a Python worker and its JVM hold at once; UDFs heed only the rows

def modest(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of ARROW_BYTES and ARROW_ROWS unless the cluster sets its own; a longer row is a batch of its own."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return spark


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there and losing an executor loses nothing."""
    modest(df.sparkSession)
    return _written(df)


def within(df: DataFrame, keys: DataFrame, on: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys`` (distinct, one column); ``keys`` is broadcast if it has few rows.

    Beyond ``broadcast_rows`` the join shuffles both sides by the key.
    """
    small = keys.count() <= broadcast_rows
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, "left_semi")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return modest(spark).read.parquet(f"{sf_dir}/{table}.parquet")
