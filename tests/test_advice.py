"""Whole jobs that a review found cut short, each against brute force on a small fixture."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfeat.functions import text
from loomfeat.operators import advisor, arrays, series, stats
from loomfeat.queries import QUERIES, STOP, VOCABULARY

SMALL = "/root/testdata/sf0.001"
PUNCTUATION = re.compile(r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""")


def _cut(x):
    return [t for t in re.split(r"[ \t\n\v\f\r]+", PUNCTUATION.sub(" ", x.lower())) if t]


def test_text_queries_take_whole_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    cleaned = {r["doc_id"]: r["cleaned"] for r in QUERIES["text_clean_documents"](spark, SMALL).collect()}
    assert cleaned.keys() == docs.keys() and all((cleaned[i] is None) == (x is None) for i, x in docs.items())
    stop = set(STOP)
    for r in QUERIES["text_vectorize_documents"](spark, SMALL).collect():
        x = docs.pop(r["doc_id"])
        own = _cut(x or "")
        assert r["bigrams"] == [f"{a} {b}" for a, b in zip(own, own[1:])]
        if x is not None:
            assert r["ids"] == ([VOCABULARY.index(t) + 2 if t in VOCABULARY else 1 for t in own] + [0] * 35)[:35]
            if x.isascii():
                assert cleaned[r["doc_id"]].split() == [t for t in own if t not in stop]
    assert not docs


@pytest.mark.parametrize("n", [1, 2, 3])
def test_ngrams_of_long_texts(spark, n):
    words = [f"w{i % 97}" for i in range(20000)]
    rows = [(1, " ".join(words)), (2, "one"), (3, ""), (4, None)]
    got = {r["id"]: r["g"] for r in spark.createDataFrame(rows, "id int, x string").select("id", text.ngrams(F.col("x"), n).alias("g")).collect()}
    assert got == {1: [" ".join(words[i : i + n]) for i in range(20000 - n + 1)], 2: ["one"] if n == 1 else [], 3: [], 4: []}


@pytest.mark.parametrize("n", [64, 7, 1])
def test_fft_modes_against_numpy(spark, n):
    rows = np.random.default_rng(n).normal(size=(5, n))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id int, a array<double>")
    for r in df.select("id", *[arrays.fft(F.col("a"), m, 4, "hann").alias(m) for m in ("power", "dominant", "stats")]).collect():
        t = np.arange(n)
        z = [(rows[r["id"]] * np.hanning(n) * np.exp(-2j * np.pi * j * t / n)).sum() for j in range(n // 2 + 1)]
        p = np.abs(z) ** 2 / max(np.abs(z) ** 2)
        bins = len(p)
        assert np.allclose(r["power"], [p[int(j)] for j in np.linspace(0, bins - 1, min(4, bins))])
        order = sorted(range(bins), key=lambda j: -p[j])[:4]
        got = np.reshape(r["dominant"], (-1, 3))
        assert np.allclose(got[:, :2], [(p[j], j / bins) for j in order])
        assert np.allclose(np.exp(1j * got[:, 2]), [z[j] / abs(z[j]) for j in order])
        d, low, mid = p - p.mean(), int(bins * 0.2), int(bins * 0.6)
        third, fourth = (d**3).mean() / (p.std() ** 3 + 1e-10), (d**4).mean() / (p.std() ** 4 + 1e-10) - 3
        assert np.allclose(r["stats"], [p.mean(), sorted(p)[bins // 2], p.std(), third, fourth, sum(p[:low]), sum(p[low:mid]), sum(p[mid:])])


def test_periodic_and_multimodal_columns(spark):
    rng = np.random.default_rng(2)
    n = 400
    values = {"wave": np.sin(np.arange(n) * 2 * np.pi / 8) + 0.1 * rng.normal(size=n), "two": rng.choice([-6.0, 6.0], n) + rng.normal(size=n), "one": rng.permutation(np.linspace(-1, 1, n) ** 3 * 5)}
    rows = [(i, *(float(x[i]) for x in values.values())) for i in range(n)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(n)], "t int, wave double, two double, one double")
    row = advisor.profile(df, list(values), ["t"])
    for parts in (1, 4, 90):  # partitions shorter than the lags too
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        acf = stats.autocorrelations(df, {c: row[c]["mean"] for c in values}, ["t"])
        for c, x in values.items():
            x = x - x.mean()
            assert np.allclose(acf[c], [(x[k:] * x[:-k]).sum() / (x * x).sum() for k in range(1, 21)])
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    keys = ("zero_ratio", "unique_ratio", "skewness", "kurtosis", "negative", "bounded01", "periodic", "multimodal")
    kind = lambda c: spark.range(1).select(advisor.detect_distribution({k: F.lit(row[c][k]) for k in keys}).alias("k")).first()["k"]
    assert (kind("wave"), kind("two")) == ("periodic", "multimodal")
    assert advisor.advise_numeric(row["two"])["distribution"] == "multimodal" and not row["one"]["periodic"]
    assert stats.periodic([0.9, 0.5, 0.1]) and not stats.periodic([0.1, 0.15, 0.1]) and not stats.periodic([0.9])


def _frequencies(x, k=5):
    c = x - x.mean()
    a = np.abs(np.fft.fft(c))[:k] if np.ptp(x) > 0 else np.zeros(0)
    a = np.r_[a, np.zeros(k - len(a))]
    square = (c * c).sum() if np.ptp(x) > 0 else 0.0
    return a / a.sum() if a.sum() else a, [(c[j:] * c[:-j]).sum() / square if square and len(c) > j else 0.0 for j in (1, 2, 3)]


def test_series_frequencies_and_windows(spark):
    rng = np.random.default_rng(6)
    data = {"a": rng.normal(size=23), "b": rng.normal(size=4), "c": np.full(6, 0.1), "d": np.array([3.0]), "e": rng.normal(size=2)}
    df = spark.createDataFrame([(g, i, float(v)) for g, x in data.items() for i, v in enumerate(x)], "g string, t int, x double").repartition(3)
    want = {(g, None): x for g, x in data.items()}
    got = {(r["g"], None): r for r in series.frequency_features(df, "x", ["g"], ["t"]).collect()}
    windows = series.sliding(df, ["g"], ["t"], 4, 3)
    want |= {(g, s): x[s : s + 4] for g, x in data.items() for s in range(0, len(x) - 3, 3)}
    got |= {(r["g"], r["window"]): r for r in series.frequency_features(windows, "x", ["g", "window"], ["t"]).collect()}
    assert got.keys() == want.keys()
    for k, x in want.items():
        coef, acf = _frequencies(x)
        assert np.allclose(got[k]["fft_coef"], coef, atol=1e-9) and np.allclose([got[k][f"autocorrelation_lag_{j}"] for j in (1, 2, 3)], acf)
    for r in series.features(windows, "x", ["g", "window"], ["t"]).collect():
        x = want[r["g"], r["window"]]
        assert np.allclose([r["mean"], r["std"], r["max"]], [x.mean(), x.std(), x.max()])
