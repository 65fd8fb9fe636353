"""Rows that the quality stage keeps, and what it writes for that."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfeat.llm import quality
from loomfeat.llm.shared import read

SMALL, ROWS = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark, rows):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)


def test_scores_do_not_depend_on_the_batch(spark):
    docs, rng = read(spark, SMALL, "documents"), np.random.default_rng(2)
    score = quality.score_of(F.col("text"), rng.normal(size=len(quality.FEATURES)), rng.normal(size=len(quality.FEATURES)))
    got = []
    for n in (1, 7, 2000):
        with batches_of(spark, n):
            got.append(sorted(map(tuple, docs.select("doc_id", score.alias("score")).collect())))
    assert got[0] == got[1] == got[2]


@pytest.mark.parametrize("few, quantile", [(10**6, 0.3), (0, 0.002)], ids=["ids of good ones broadcast", "all scored"])
def test_keep_good_keeps_what_scored_says_and_writes_no_text(spark, monkeypatch, few, quantile):
    docs, labels = read(spark, SMALL, "documents"), read(spark, SMALL, "labels")
    odd = [(None, "a row without an id, scored for itself"), (None, None), (-1, ""), (-1, "of two rows with one id, one is empty")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True).withColumn("_score", F.lit("mine"))
    counts = lambda df: sorted(map(tuple, df.groupBy("doc_id").count().collect()), key=repr)
    want = counts(quality.scored(docs, labels, good_quantile=quantile).filter("kept"))
    tables = []
    monkeypatch.setattr(quality, "FEW", few, raising=False)
    monkeypatch.setattr(quality, "written", lambda df, write=quality.written: (tables.append(df.columns), write(df))[1])
    with batches_of(spark, 7):  # other rows around each row than in scored()
        got = quality.keep_good(docs, labels, good_quantile=quantile)
        assert got.dtypes == docs.dtypes and counts(got) == want
    assert tables and all(set(c) <= {"doc_id", "quality", "score"} for c in tables)
