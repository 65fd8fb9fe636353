"""Links of buckets against all pairs by every path, and components by either way."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfeat.llm import neardup


def _parts(ids, edges):
    node, group = neardup.union_find(np.array([a for a, _ in edges] + list(ids)), np.array([b for _, b in edges] + list(ids)))
    return dict(zip(node.tolist(), group.tolist(), strict=True))


def _sets(rng, clusters, alone, size=60, template=25):
    """Tight and loose clusters around centres, and sets that only share a template."""
    same = rng.integers(0, 2**32, template, dtype=np.uint32)
    out = []
    for n, noise in clusters:
        centre = np.r_[same, rng.integers(0, 2**32, size, dtype=np.uint32)]
        for _ in range(n):
            x = centre.copy()
            k = rng.integers(0, noise + 1)
            x[rng.choice(len(x), k, replace=False)] = rng.integers(0, 2**32, k, dtype=np.uint32)
            out.append(np.unique(x))
    out += [np.unique(np.r_[same, rng.integers(0, 2**32, size, dtype=np.uint32)]) for _ in range(alone)]
    return out


def _frame(spark, sets):
    return spark.createDataFrame(pa.table({"doc_id": pa.array(range(len(sets)), pa.int64()), "shingles": pa.array([x.tobytes() for x in sets], pa.binary())}))


def _all_pairs(sets, threshold):
    return [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(np.intersect1d(sets[i], sets[j])) >= threshold * len(np.union1d(sets[i], sets[j]))]


def test_alike_is_the_jaccard_index():
    sets = _sets(np.random.default_rng(1), [(9, 30), (12, 50)], 8) + [np.zeros(0, np.uint32)]
    near = neardup.alike(sets, 0.5)
    assert sorted(zip(*np.nonzero(np.triu(near, 1)), strict=True)) == _all_pairs(sets[:-1], 0.5)


@pytest.mark.parametrize("turns", [0, 3])
def test_large_buckets_connect_what_all_pairs_do(spark, turns):
    sets = _sets(np.random.default_rng(2), [(30, 5), (25, 45), (12, 60)], 40)
    buckets = spark.createDataFrame([(b, i, len(sets)) for b in (1,) for i in range(len(sets))], "bucket long, doc_id long, n long")
    got = {(min(r), max(r)) for r in neardup.links_of(buckets, _frame(spark, sets), block=6, turns=turns).filter("a <> b").collect()}
    true = set(_all_pairs(sets, 0.5))
    assert got <= true and _parts(range(len(sets)), got) == _parts(range(len(sets)), true)


def test_ten_thousand_unlike_documents_in_a_bucket(spark):
    sets = _sets(np.random.default_rng(3), [(600, 4)], 10_000)
    frame = _frame(spark, sets).repartition(4)
    buckets = frame.select(F.lit(7).cast("long").alias("bucket"), "doc_id", F.lit(len(sets)).cast("long").alias("n"))
    began = time.time()
    links = neardup.links_of(buckets, frame).filter("a <> b").collect()
    assert time.time() - began < 120
    assert len(set(_parts(range(len(sets)), [tuple(r) for r in links]).values())) == 10_001


def test_components_by_contraction(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = _parts([], edges)
    for most in (10**6, 0):
        assert {r["doc_id"]: r["group_id"] for r in neardup.components(frame, most).collect()} == want


def test_one_of_each_keeps_rows_and_columns_as_they_are(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text, 7), (2, text, 8), (3, text + " more", 9), (None, text, 1), (None, text, 2), (4, None, 3), (5, "", 4), (6, "quite another one", 5), (6, "quite another one", 5), (6, "and yet a different text here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash int").withColumn("bucket", F.lit("x"))
    got = neardup.one_of_each(df)
    assert got.dtypes == df.dtypes
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == sorted([rows[0], *rows[3:7], rows[9]], key=repr)
    assert neardup.one_of_each(df.limit(0)).count() == 0 and neardup.near_duplicates(df.limit(0)).count() == 0
    links = {r["doc_id"]: (r["group_size"], r["links"]) for r in neardup.near_duplicates(df).collect()}
    assert links[1] == (3, 2) and links[4] == links[5] == (1, 0)
