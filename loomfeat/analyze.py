"""Advice for a CSV table: ``python -m loomfeat.analyze DATA.csv --output advice.json [--stats stats.json] [--feature-types types.json] [--order a,b]``."""

from __future__ import annotations

import argparse
import json
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from loomfeat.operators import advisor, stats
from loomfeat.plans.pipeline import FeatureType
from loomfeat.sources.csv import read_csv


def analyze(spark: SparkSession, data: str, types: str | None = None, order: Sequence[str] | None = None) -> dict:
    """What auto_configure says of the table, and the statistics of its numeric columns."""
    df = read_csv(spark, data)
    known = advisor.read_types(types, list(FeatureType.__members__)) if types else None
    out = advisor.auto_configure(df, known, order)
    numbers = [c for c, t in out["types"].items() if t.startswith("FLOAT")]
    row = df.agg(*stats.numeric(numbers)).first() if numbers else {}
    return out | {"statistics": {c: row[c].asDict() for c in numbers}}


def main(args: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="python -m loomfeat.analyze", description="Statistics of a table and a recommended pipeline.")
    p.add_argument("data", help="a CSV file or folder, with a header")
    p.add_argument("--output", default="advice.json", help="where the advice goes, as JSON")
    p.add_argument("--stats", help="where the statistics go or, if they are there and --overwrite is not given, stay")
    p.add_argument("--feature-types", help="JSON of column names and types; inferred without")
    p.add_argument("--order", help="columns of a total order, by which periods are found")
    p.add_argument("--overwrite", action="store_true", help="replace files that are there")
    a = p.parse_args(args)
    if os.path.exists(a.output) and not a.overwrite:
        p.error(f"{a.output} is there: give --overwrite")
    spark = SparkSession.builder.appName("analyze").getOrCreate()
    found = analyze(spark, a.data, a.feature_types, a.order.split(",") if a.order else None)
    if a.stats and (a.overwrite or not os.path.exists(a.stats)):
        with open(a.stats, "w") as f:
            json.dump(found["statistics"], f, indent=2)
    with open(a.output, "w") as f:
        json.dump(found, f, indent=2)
    print(found["snippet"])


if __name__ == "__main__":
    main()
