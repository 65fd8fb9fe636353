"""Fitted pipelines on streams: their expressions keep no state, so they run on a streaming table unchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from loomfeat.plans.pipeline import Fitted


def start(fitted: Fitted, stream: DataFrame, path: str, checkpoint: str, output: str = "dict", keep: Sequence[str] = ()) -> StreamingQuery:
    """Write the transformed rows of what is there as Parquet, and end."""
    out = fitted.transform(stream, output, keep).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()
