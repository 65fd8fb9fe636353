"""History for inference on time series: sufficiency per group, combination with new rows, frames of future steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomfeat.sources.scratch import free


def required_history(lags: Sequence[int] = (), window_size: int = 0, order: int = 0, periods: Sequence[int] = (), levels: int = 0) -> int:
    return max([1, *lags, window_size, order, *periods, 2**levels if levels else 0])


def requirements(**options: object) -> str:
    return f"Each series needs {required_history(**options)} earlier rows."


def insufficient(df: DataFrame, group: Sequence[str], need: int) -> DataFrame:
    """Groups with fewer than ``need`` rows, and how many they have."""
    return df.groupBy(*group).agg(F.count("*").alias("rows")).filter(F.col("rows") < need)


def combine(history: DataFrame, new: DataFrame) -> DataFrame:
    """Both with ``is_new``; columns that one side lacks are NULL there."""
    return history.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)), allowMissingColumns=True)


def future(df: DataFrame, group: Sequence[str], date: str, steps: int) -> DataFrame:
    """(group, date) of the ``steps`` days after the last date of each group."""
    last = df.groupBy(*group).agg(F.max(F.col(date).cast("date")).alias("__last"))
    return last.select(*group, F.explode(F.sequence(F.date_add("__last", 1), F.date_add("__last", steps))).alias(date))


def ordered(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """All rows by group and time."""
    return df.orderBy(*group, *order)


def incremental(history: DataFrame, new: DataFrame, group: Sequence[str], order: Sequence[str], need: int) -> DataFrame:
    """The new rows after the last ``need`` rows of history of each of their series, by group and time; ``is_new`` tells them apart.

    Only series that have new rows take part; their history is cut by a ranking that keeps ``need`` rows of a group.
    """
    w = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    rank = free("__rank", history)
    late = history.join(new.select(*group).distinct(), list(group), "left_semi").withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= need).drop(rank)
    return ordered(combine(late, new), group, order)


def checked(df: DataFrame, group: Sequence[str], need: int) -> DataFrame:
    """The table as it is, or an error that names some of the series that are too short."""
    short = insufficient(df, group, need).orderBy(*group).limit(6).collect()
    if short:
        shown = ", ".join(str(tuple(r)[:-1]) for r in short[:5]) + (", ..." if len(short) > 5 else "")
        raise ValueError(f"each series needs {need} rows; fewer have {shown}")
    return df
