"""Rows that are in memory already."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def from_memory(spark: SparkSession, data: Mapping[str, object] | pd.DataFrame) -> DataFrame:
    """A table of a pandas frame, or of a mapping from names to columns; single values are columns of one row."""
    if not isinstance(data, pd.DataFrame):
        columns = {k: list(v) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 1) else [v] for k, v in data.items()}
        data = pd.DataFrame(columns)
    return spark.createDataFrame(data)
