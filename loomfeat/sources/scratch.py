"""Tables written in the folder that all executors share: lineage ends there, and losing an executor loses nothing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir.

    Where that is unset and everything runs on one machine, as in tests, a folder of this machine is set instead; on a
    cluster it is refused, since each executor would write its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomfeat-")
        spark.sparkContext.setCheckpointDir(base)
        _made.append((spark, base))
    path = f"{base.rstrip('/')}/loomfeat-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def clean() -> None:
    """Delete every folder that scratch() named; called when the driver ends, or earlier if the results are used up."""
    while _made:
        spark, path = _made.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone, and the cluster's own cleaning remains
            pass


atexit.register(clean)


def written(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(name: str, *frames: DataFrame) -> str:
    """The name, with underscores after it until no column of the frames has it, whatever its case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
