"""Redaction by either path, and the threshold of toxicity over all labelled documents."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfeat.llm import pii, toxicity


def test_redaction_by_join_is_mask_of_each_row(spark):
    line = "please write to user{0}@mail{0}.org or call +1 555-010-{1} soon; key id {2} ends"
    texts = [line.format(i, 1000 + i, i * 7919) for i in range(12)]
    # rows that share a doc_id or have none, with other texts, the same text, and nothing to hide
    rows = [(1, texts[0]), (1, "shorter: write to a.b@c.org now"), (1, "clean text of the same document, long enough to be cut by foreign spans"), (1, texts[0])]
    rows += [(None, t) for t in texts] + [(None, "no identifier stands in this text, which has no doc_id either"), (None, None), (2, ""), (3, "room 12 of 40")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = pii.extract(df)
    scores = {}
    for r in pii.pattern_scores(found).collect():
        scores.setdefault(r["pattern"], []).append((r["kind"], r["score"]))
    assert scores
    want = [(i, t if t is None else pii.mask(t, scores, pii.THRESHOLD)) for i, t in rows]
    for most in (0, 10**6):
        got = pii.redact(df, local_patterns=most)
        assert got.columns == df.columns
        got = got.collect()
        assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(want, key=repr)


def _cut_by_hand(score, y, weight):
    points = np.unique(score)
    places = [points[0] - 1, *((points[:-1] + points[1:]) / 2), points[-1] + 1]
    gaps = [1.0, *np.diff(points), 1.0]
    errors = [(y[score < p] == 1).sum() + weight * (y[score >= p] == 0).sum() for p in places]
    return -max((g, -p) for e, g, p in zip(errors, gaps, places) if e <= min(errors) + 1e-9)[1], min(errors)


@pytest.mark.parametrize("case, weight", [("mixed", 1.0), ("mixed", 0.3), ("apart", 1.0), ("toxic", 1.0), ("clean", 1.0)])
def test_cut_over_all_counts(spark, case, weight):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 500) if case in ("mixed", "apart") else np.full(500, int(case == "toxic"))
    score = np.round(64 * (rng.normal(size=500) + y * (9 if case == "apart" else 1.5))) / 64  # exact gaps
    got = toxicity.best_cut(spark.createDataFrame([(float(s), int(t)) for s, t in zip(score, y)], "score double, y int").repartition(5), weight)
    want, least = _cut_by_hand(score, y, weight)
    assert abs((y[score < got] == 1).sum() + weight * (y[score >= got] == 0).sum() - least) < 1e-9
    if case in ("mixed", "apart"):
        assert abs(got - want) < 1e-9


def test_toxic_threshold_sees_labels_beyond_the_sample(spark):
    # clean rows outside the sample of 60 a class hold the toxic words as well, and outnumber the toxic ones
    rows = [(i, f"good{i % 7} bad word{i % 5} vile") for i in range(100)] + [(i, f"good{i % 7} nice word{i % 5} kind") for i in range(100, 200)]
    first = spark.createDataFrame([(i,) for i in range(100, 700)], "doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id").limit(60)
    inside = {r["doc_id"] for r in first.collect()}
    rows = rows[:100] + [(i, f"good{i % 7} nice word{i % 5} kind" if i in inside else f"good{i % 7} bad word{i % 5} vile") for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(700)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, sample_rows=60).filter("toxic").count()
    assert got == 0  # flagging would be wrong for 540 clean rows and right for 100 toxic ones
