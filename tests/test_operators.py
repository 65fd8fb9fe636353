"""Hand-computed values, and the invariants that SQL can't show."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomfeat.functions import dates, numeric, text
from loomfeat.operators import advisor, arrays, inference, neural, series, stats
from loomfeat.plans.pipeline import Feature, Fitted, Pipeline
from loomfeat.sources.csv import read_csv, write_csv
from loomfeat.streaming.apply import start


def line(spark, values, group="a"):
    return spark.createDataFrame([(group, i, float(v) if v is not None else None) for i, v in enumerate(values)], "g string, t int, x double")


W = (["g"], ["t"])


def col(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


@pytest.mark.parametrize("values, mean", [([1, 2, 3, 4, 5], [2, 3, 4]), ([3, 9, 0, 6, 3], [4, 5, 3])])
def test_rolling(spark, values, mean):
    df = line(spark, values)
    out = series.rolling(F.col("x"), series.window(*W), 3, ["mean"])
    assert col(df.withColumns(out), "rolling_mean") == [None, None, *mean]


@pytest.mark.parametrize("values, order, want", [([1, 3, 5, 7, 9], 1, [2, 2, 2, 2]), ([5, 1, 4, 4, 0], 1, [-4, 3, 0, -4]), ([1, 4, 9, 16, 25], 2, [2, 2, 2]), ([1, 2, 4, 8, 16], 2, [1, 2, 4])])
def test_difference(spark, values, order, want):
    df = line(spark, values).withColumn("d", series.difference(F.col("x"), series.window(*W), order))
    assert col(series.trimmed(df, series.window(*W), order), "d") == want


def test_groups_do_not_leak(spark):
    df = line(spark, range(5)).union(line(spark, range(5), "b"))
    out = df.withColumns(series.lags(F.col("x"), series.window(*W), [1], 0.0)).filter("t = 0")
    assert {r["lag_1"] for r in out.collect()} == {0.0}


def test_decomposition_adds_up(spark):
    out = series.decompose(line(spark, np.random.default_rng(0).normal(size=40)), "x", *W, period=7)
    assert all(abs(r["trend"] + r["seasonal"] + r["residual"] - r["x"]) < 1e-12 for r in out.collect())


@pytest.mark.parametrize("strategy, want", [("forward", [None, 1, 1, 1, 4, 4]), ("backward", [1, 1, 4, 4, 4, None]), ("linear", [1, 1, 2, 3, 4, None]), ("mean", [2.5, 1, 2.5, 2.5, 4, 2.5])])
def test_missing(spark, strategy, want):
    out = series.fill_missing(line(spark, [None, 1, None, None, 4, None]), "x", *W, strategy)
    assert col(out, "filled") == want
    assert col(out, "was_missing") == [1, 0, 1, 1, 0, 1]


def test_dates(spark):
    df = spark.createDataFrame([("2025-01-17",), ("2024/06/16",), ("2023-02-31",), ("20230115",), (None,)], "s string")
    rows = df.select(dates.parse(F.col("s")).alias("d")).select(dates.day_of_week(F.col("d")).alias("w"), dates.season(F.col("d")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [(5, "winter"), (0, "summer"), (None, None), (None, None), (None, None)]


def test_one_hot_sums_to_one(spark):
    df = spark.range(10).select(numeric.one_hot(numeric.bucket(F.col("id"), [2, 5]), 3).alias("h"))
    assert {sum(r["h"]) for r in df.collect()} == {1.0}


def test_single_value_has_no_variance(spark):
    s = line(spark, [5]).agg(*stats.numeric(["x"])).first()["x"]
    assert (s["mean"], s["var"], s["count"]) == (5.0, 0.0, 1)


def test_fft_and_wavelet(spark):
    x = np.random.default_rng(1).normal(size=(3, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(3, None), (4, [])], "id int, a array<double>")
    rows = {r["id"]: r for r in df.select("id", arrays.fft(F.col("a"), "full", 5).alias("p"), arrays.wavelet(F.col("a"), 1).alias("w")).collect()}
    assert rows[3]["p"] is None and rows[4]["w"] is None
    for i, v in enumerate(x):
        assert np.allclose(rows[i]["p"], arrays.spectrum(v[None])[0, :5])
        smooth = np.convolve(v, [0.5, 0.5], "valid")
        assert np.allclose(rows[i]["w"], np.r_[v[1:] - smooth, smooth] / 16)


def test_neural_blocks_do_not_depend_on_partitions(spark):
    df = spark.range(50).select("id", F.array(F.col("id") / 50, F.sin("id"), F.cos("id")).alias("v"))
    for block in neural.BLOCKS:
        options = {"numeric": 2} if block == "multi_resolution" else {}
        a, b = (dict(x.select("id", neural.apply(F.col("v"), block, 4, **options)).toPandas().values.tolist()) for x in (df, df.repartition(7)))
        assert all(np.allclose(a[i], b[i]) for i in a)
    w = neural.Weights(0)
    share = neural.variable_selection(np.ones((1, 3)), w, 4)[0, :3]
    assert abs(share.sum() - 1) < 1e-12 and neural.describe(w)


def test_pipeline_saves_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), (None, None)], "k string, x double")
    fitted = Pipeline([Feature("k", "string_categorical"), Feature("x", "FLOAT")]).fit(df)
    fitted.save(str(tmp_path / "p.json"))
    again = Fitted.load(str(tmp_path / "p.json"))
    want = fitted.transform(df).collect()
    assert again(df).collect() == want
    write_csv(df, str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, x double").option("header", True).csv(str(tmp_path / "in"))
    start(again, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda r: str(r)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(want, key=key)
    assert read_csv(spark, str(tmp_path / "in")).count() == 3


def test_pipeline_refuses_unknown(spark):
    with pytest.raises(ValueError):
        Feature("x", "FLOAT", {"lag_indices": [1]})
    with pytest.raises(ValueError):
        Feature("x", "COMPLEX")


def test_advice():
    assert advisor.advise_categorical(10) == {"encoding": "one_hot"}
    assert advisor.advise_categorical(1000)["hash_bins"] == 3000
    assert advisor.advise_numeric({"var": 0.0})["distribution"] == "constant"
    assert "Feature('a'" in advisor.snippet({"a": {"feature_type": "FLOAT"}})
    assert inference.required_history(lags=[1, 7], levels=4) == 16


def test_global_ranks_keep_every_row(spark):
    """With payload columns and many partitions, against the window over everything that the operator avoids."""
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    x = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 101 == 0, None).otherwise(F.rand(1))
    df = spark.range(40_000).select("id", x.alias("x"), *[F.md5(F.col("id").cast("string")).alias(f"p{i}") for i in range(4)], F.lit("clash").alias("__place"))
    for coalesce in (True, False):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = stats.rank_to_uniform(df, "x", "id", "q")
        assert got.columns == [*df.columns, "q"]
        n = df.filter("x is not null").count()
        want = df.select("id", F.when(F.col("x").isNotNull(), 2 * (F.row_number().over(Window.orderBy(F.col("x").asc_nulls_last(), "id")) - 0.5) / n - 1).alias("w"))
        both = got.join(want, "id", "full")
        assert both.count() == got.count() == 40_000 and both.filter("not (q <=> w)").count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert stats.ranked(df.limit(0), ["x", "id"]).count() == 0


def test_dense_places_keep_rows_without_a_value(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0), (4, 5.0), (5, 2.0)], "t int, x double")
    for most in (0, 10):
        got = stats.dense(df, "x", "place", most)
        assert {r["t"]: r["place"] for r in got.collect()} == {1: 1.0, 2: None, 3: 0.0, 4: 1.0, 5: 0.5}


def test_blocks_keep_rows_last_in_memory_and_round_in_the_batch(spark):
    x = np.random.default_rng(4).normal(size=(5000, 4))
    for block, run in neural.BLOCKS.items():
        options = {"numeric": 2} if block == "multi_resolution" else {}
        y = run(np.asfortranarray(x), neural.Weights(0), 4, **options)
        assert y.strides[0] == 8 and np.allclose(y[4990:], run(x[4990:].copy(), neural.Weights(0), 4, **options), atol=1e-12)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, v array<double>").coalesce(1)
    got = {r["i"]: r["y"] for r in df.select("i", neural.apply(F.col("v"), "transformer", 4, digits=3).alias("y")).collect()}
    assert np.allclose([got[i] for i in range(5000)], neural.transformer(x, neural.Weights(0), 4), atol=0.0005001) and all(round(v, 3) == v for v in got[4999])
    assert neural._rounded(np.array([0.125, -0.125, -0.001, np.nan, np.inf]), 2).tolist()[:3] == [0.13, -0.13, 0.0]


def test_tf_idf_shuffles_counts_once_and_joins_equal_keys(spark):
    rows = [(1, "a b a"), (1, "a c"), (None, "b b"), (None, "b"), (2, None), (3, " ,; "), (4, "c C c. d" * 2)]
    df = spark.createDataFrame(rows, "k int, x string").repartition(3)
    out = text.tf_idf(df, "k", "x")
    got = {(r["k"], r["token"]): (r["tf"], r["df"], r["tf_idf"]) for r in out.collect()}
    want = {(1, "a"): (3, 1), (1, "b"): (1, 2), (1, "c"): (1, 2), (None, "b"): (3, 2), (4, "c"): (5, 2), (4, "d"): (1, 1), (4, "dc"): (1, 1)}
    assert got.keys() == want.keys()
    assert all(got[k][:2] == v and abs(got[k][2] - v[0] * (np.log(8 / (1 + v[1])) + 1)) < 1e-12 for k, v in want.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and plan.count("Join") == 1  # with the number of rows only


@pytest.mark.parametrize("collected", [0, 7, 10_000])
def test_percentiles_in_brackets_are_the_exact_ones(spark, collected):
    rng = np.random.default_rng(8)
    many = {"wide": np.r_[rng.normal(size=900), 1e300, -1e300, np.inf], "equal": np.full(500, 0.1), "ties": rng.integers(0, 3, 701), "one": [2.5], "nan": np.r_[rng.normal(size=300), [np.nan] * 200], "only_nan": [np.nan, np.nan]}
    shares = (0.0, 0.1, 0.25, 0.5, 0.613, 0.75, 1.0)
    for x in many.values():
        df = spark.createDataFrame([(None,), *((float(v),) for v in x)], "v double").repartition(3)
        want = df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
        assert np.array_equal(stats.percentiles(df, "v", shares, collected), want, equal_nan=True)
    assert stats.percentiles(spark.createDataFrame([(None,)], "v double"), "v", shares) == [None] * 7


def test_tokens_are_cut_once_for_several_results(spark):
    texts = [None, "", " ", "a", "?!", "The-CAT  sat\ton\n\x0b[the] mat_é　x", "a b\\c^d`e~", ".a b.", "\r\f x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    before = F.filter(F.split(text.clean(F.col("x")), " "), lambda t: t != "")
    assert all(r["a"] == r["b"] for r in df.select(before.alias("a"), text.tokens(F.col("x")).alias("b")).collect())
    x, own = F.col("x"), F.col("own")
    many = df.select("x", text.tokens(x).alias("own")).select(text.vectorize(x, ["the"], 5, own=own).alias("v"), text.multi_hot(x, ["the"], own).alias("h"), text.ngrams(x, 2, own).alias("g"))
    assert many.collect() == df.select(text.vectorize(x, ["the"], 5).alias("v"), text.multi_hot(x, ["the"]).alias("h"), text.ngrams(x, 2).alias("g")).collect()
    assert many._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
