"""Every kind of feature and option through fit and transform, saved and read again; advice that runs; steps by name."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomfeat import analyze
from loomfeat.functions import text
from loomfeat.operators import advisor, arrays, inference, neural, series
from loomfeat.plans import steps
from loomfeat.plans.pipeline import Feature, Fitted, Pipeline, split
from loomfeat.sources.csv import write_csv
from loomfeat.sources.memory import from_memory

SERIES = {"group": ["store"], "order": ["day"]}


@pytest.fixture(scope="module")
def sales(spark):
    """Two stores of five days: one rises by 2 a day, one falls."""
    rows = [("A", f"2024-01-{i + 1:02d}", 100.0 + 2 * i) for i in range(5)] + [("B", f"2024-01-{i + 1:02d}", 300.0 - 2 * i) for i in range(5)]
    return spark.createDataFrame(rows, "store string, day string, sales double").withColumn("day", F.to_date("day")).repartition(3)


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_series_features_keep_to_their_group(sales):
    f = Feature("sales", "TIME_SERIES", SERIES | {"lags": [1, 3], "difference_order": 1, "averages": [2]})
    got = Pipeline([f]).fit(sales).transform(sales, "dict", ["store", "day"])
    a = [r[2] for r in rows(got, "store", "day")]
    assert a[0] == [100, None, None, None, 100] and a[4] == [108, 106, 102, 2, 107] and a[5] == [300, None, None, None, 300] and a[9] == [292, 294, 298, -2, 293]
    trimmed = Pipeline([f]).fit(sales).transform(sales, "concat", ["store", "day"], drop_na=True)
    assert [r[0] for r in rows(trimmed, "store", "day")] == ["A", "A", "B", "B"]


def test_series_features_one_after_the_other(sales):
    f = Feature("sales", "TIME_SERIES", SERIES | {"lags": [1], "difference_order": 1, "parallel": False, "keep_original": False})
    got = [r[2] for r in rows(Pipeline([f]).fit(sales).transform(sales, "dict", ["store", "day"]), "store", "day")]
    assert got == [[None], [None], [2], [2], [2], [None], [None], [-2], [-2], [-2]]


def test_series_with_everything(sales, tmp_path):
    o = SERIES | {"lags": [1], "rolling_size": 2, "difference_order": 1, "averages": [2], "missing": "forward", "wavelet": 2, "fft": 3, "history": 8, "features": ["mean", "slope"], "calendar": ["day"]}
    df = sales.withColumn("sales", F.when(F.dayofmonth("day") != 2, F.col("sales")))
    fitted = Pipeline([Feature("sales", "TIME_SERIES", o), Feature("store", "STRING_CATEGORICAL"), Feature("day", "DATE")]).fit(df)
    width = fitted.widths(df)
    got = rows(fitted.transform(df, "concat", ["store", "day"]), "store", "day")
    assert {len(r[2]) for r in got} == {sum(width.values())} and width["store"] == 3 and width["day"] == 8
    assert got[1][2][0] == 100.0  # filled from the day before
    last = np.array([0, 0, 0, 100, 100, 104, 106, 108.0])
    power = np.abs(np.fft.rfft(last)) ** 2
    assert np.allclose(got[4][2][width["sales"] - 3 : width["sales"]], [power[0] / power.max(), power[2] / power.max(), power[4] / power.max()])
    path = str(tmp_path / "p.json")
    fitted.save(path)
    assert rows(Fitted.load(path).transform(df, "concat", ["store", "day"]), "store", "day") == got
    assert fitted.required_history() == 8
    with pytest.raises(ValueError, match="each series needs 8"):
        fitted.predict(df)
    assert Pipeline([Feature("sales", "TIME_SERIES", SERIES | {"lags": [1, 4]})]).fit(df).predict(df, "dict").count() == 10


def test_transforms_by_name(spark):
    x = [0.5, 1.0, 2.0, 4.0, None, 8.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    get = lambda **o: [r[1] for r in rows(Pipeline([Feature("x", "FLOAT", o)]).fit(df).transform(df, "dict", ["i"]), "i")]
    assert get(transform="min_max") == [0.0, 0.5 / 7.5, 1.5 / 7.5, 3.5 / 7.5, None, 1.0]
    assert get(transform="robust")[2] == 0 and get(transform="robust")[4] is None
    assert np.allclose(np.array(get(transform="quantile"), float), [-0.8, -0.4, 0, 0.4, np.nan, 0.8], equal_nan=True)
    assert np.allclose(np.array(get(transform="log"), float), np.log(np.array(x, float) + 1e-10), equal_nan=True)
    assert np.allclose(np.array(get(transform="yeo_johnson", **{"lambda": 0.0}), float), np.log1p(np.array(x, float)), equal_nan=True)
    assert np.allclose(np.array(get(transform="box_cox", **{"lambda": 0.0}), float), np.log(np.array(x, float)), equal_nan=True)
    for t in ("sqrt", "logit", "arcsinh", "cube_root", "yeo_johnson", "box_cox", "none"):
        assert [v is None for v in get(transform=t)] == [v is None for v in x]
    assert np.allclose(np.array(get(transform="yeo_johnson", **{"lambda": 2.0}), float), ((np.array(x, float) + 1) ** 2 - 1) / 2, equal_nan=True)
    assert get(transform="auto") == get(transform="box_cox", **{"lambda": 0.5})
    assert {len(v) for v in get(distribution_aware=True) if v} == {3 + 13}
    assert {len(v) for v in get(embedding_dim=4, num_bins=5)} == {4}


@pytest.mark.parametrize("o", [{"transform": "rot13"}, {"speed": 1}])
def test_unknown_options_and_values_are_refused(o):
    with pytest.raises(ValueError):
        Feature("x", "FLOAT", o)
    with pytest.raises(ValueError):
        Feature("x", "STRING_CATEGORICAL", {"encoding": "embeding"})
    with pytest.raises(ValueError):
        Feature("x", "TIME_SERIES", {"lags": [1]})
    with pytest.raises(ValueError):
        Feature("x", "FLOAT", steps=["no such step"])


@pytest.mark.parametrize("n", [7, 1500])
def test_vocabularies_of_any_size(spark, tmp_path, n):
    df = spark.range(2 * n).select("id", F.format_string("v%05d", F.col("id") % n).alias("s"), (F.col("id") % n - 3).alias("k")).union(spark.createDataFrame([(-1, None, None)], "id long, s string, k long"))
    fitted = Pipeline([Feature("s", "STRING_CATEGORICAL", {"encoding": "index"}), Feature("k", "INTEGER_CATEGORICAL", {"encoding": "embedding", "embedding_dim": 3})]).fit(df)
    table = neural.Weights(0)("k.embedding", n + 1, 3)
    path = str(tmp_path / "v.json")
    fitted.save(path)
    for f in (fitted, Fitted.load(path, spark)):
        got = rows(f.transform(df.union(spark.createDataFrame([(-2, "unseen", 10**6)], "id long, s string, k long")), "dict", ["id"]), "id")
        assert [r[1] for r in got] == [0, 0, *(i % n + 1 for i in range(2 * n))]
        assert np.allclose([r[2] for r in got], table[[r[1] for r in got]])
    if n < 1000:
        assert len(Pipeline([Feature("s", "STRING_CATEGORICAL")]).fit(df).transform(df, "concat").first()[0]) == n + 1


def test_text_learns_its_words(spark):
    docs = [(1, "the cat and the dog"), (2, "The dog, again!"), (3, None), (4, "")]
    df = spark.createDataFrame(docs, "i int, t string").withColumn("x", F.lit(1.0))
    fitted = Pipeline([Feature("x", "FLOAT_RESCALED"), Feature("t", "TEXT", {"length": 4, "max_tokens": 3, "stop_words": ["again"]})]).fit(df)
    assert fitted.stats["t"]["vocabulary"] == ["the", "dog", "and"]
    assert [r[1] for r in rows(fitted.transform(df, "concat", ["i"]), "i")] == [[1, 2, 1, 4, 2], [1, 2, 3, 0, 0], [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]]
    many = [f"w{i}" for i in range(1500)]
    got = df.select(text.vectorize(F.lit("w1499 no w0"), many, 4).alias("v"), text.vectorize(F.lit(None).cast("string"), many, 4).alias("n")).first()
    assert (got["v"], got["n"]) == ([1501, 1, 2, 0], None)
    hot = Pipeline([Feature("t", "TEXT", {"vocabulary": ["cat", "dog"], "output": "multi_hot"})]).fit(df).transform(df, "dict", ["i"])
    assert [r[1] for r in rows(hot, "i")] == [[1, 1], [0, 1], [0, 0], [0, 0]]


def test_steps_by_name_are_saved(spark, tmp_path):
    df = spark.createDataFrame([(1, " 4 "), (2, "x")], "i int, s string")
    steps.register("trimmed", lambda: F.trim)
    own = Feature("s", "PASSTHROUGH", steps=["trimmed", ("hash_bucket", {"bins": 7})])
    fitted = Pipeline([own]).fit(df)
    path = str(tmp_path / "s.json")
    fitted.save(path)
    assert rows(Fitted.load(path).transform(df, "dict", ["i"]), "i") == rows(fitted.transform(df, "dict", ["i"]), "i")
    assert rows(df.select("i", steps.chain(F.trim, ("hash_bucket", {"bins": 7}))(F.col("s"))), "i") == rows(fitted.transform(df, "dict", ["i"]), "i")
    with pytest.raises(ValueError):
        steps.create("rescale", factor=2)
    with pytest.raises(ValueError):
        steps.register("trimmed", lambda: F.trim)
    with pytest.raises(ValueError):
        Pipeline([Feature("s", "PASSTHROUGH", steps=[F.trim])]).fit(df).save(path)
    assert {"zscore", "flatten", "clean", "cyclic"} <= set(steps.names())


def test_blocks_over_the_vector(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(6)], "i int, a double, b double")
    plain = Pipeline([Feature("a", "FLOAT"), Feature("b", "FLOAT_RESCALED")]).fit(df)
    x = np.array([r[1] for r in rows(plain.transform(df, "concat", ["i"]), "i")])
    got = np.array([r[1] for r in rows(plain.with_block("moe", 2, residual=True, top=1).transform(df, "concat", ["i"]), "i")])
    w = neural.Weights(0)
    assert np.allclose(got, x + neural.mixture(x, w, 2, top=1))
    routed = neural.mixture(x, w, 2, experts=2, routing=np.array([0.25, 0.75]))
    assert np.allclose(routed, 0.25 * np.maximum(x @ w.given["moe.0"], 0) + 0.75 * np.maximum(x @ w.given["moe.1"], 0))
    context = [[0.0, 1.0], [2.0, 0.0]]
    one = plain.with_block("tabular_attention", 4, context=context)
    a, b = (sorted(map(tuple, (r["features"] for r in one.transform(d, "concat").collect()))) for d in (df, df.repartition(5)))
    assert np.allclose(a, b) and {len(v) for v in a} == {8}
    assert neural.numerical_embedding(x, w, 3, pool="mean").shape == neural.numerical_embedding(x, w, 3, pool="max").shape == (6, 3)
    m = df.select(neural.stack([F.array("a", "b"), F.array("b", "a")]).alias("m")).select(*neural.unstack(F.col("m"), 2)).first()
    assert (list(m[0]), list(m[1])) == ([0.0, 0.0], [0.0, 0.0])


def test_arrays_of_unequal_length(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None, 3.0]), (4, [])], "i int, a array<double>")
    got = {r[0]: r[1] for r in rows(df.select("i", neural.apply(F.col("a"), "glu", 3)), "i")}
    w = neural.Weights(0)
    assert got[2] is None and got[4] is None and np.allclose(got[1], neural.gated_linear_unit(np.array([[1.0, 2.0]]), w, 3)[0]) and len(got[3]) == 3
    assert arrays.by_length(pa.array([], pa.list_(pa.float64())), lambda x: x).to_pylist() == []
    assert [list(x) for x in df.limit(1).select(*split(F.array(*map(F.lit, range(5))), [(1, 2), (0, 1)])).first()] == [[1, 2], [0]]


def test_advice_runs(spark, tmp_path):
    rng = np.random.default_rng(1)
    n = 400
    data = pd.DataFrame({
        "t": np.arange(n), "flat": np.ones(n), "heavy": rng.standard_t(2, n), "skewed": rng.exponential(1, n), "none": np.where(rng.random(n) < 0.7, 0, 5.0), "wave": np.sin(np.arange(n) * 2 * np.pi / 40),
        "few": rng.choice(list("abc"), n), "some": [f"s{i % 70}" for i in range(n)], "many": [f"m{i}" for i in range(n)], "words": [f"a text of some words {i} and more of them" for i in range(n)], "day": [f"2024-{i % 12 + 1:02d}-03" for i in range(n)],
    })
    df = from_memory(spark, data)
    types = {"flat": "FLOAT_NORMALIZED", "heavy": "FLOAT_NORMALIZED", "skewed": "FLOAT_NORMALIZED", "none": "FLOAT_NORMALIZED", "wave": "FLOAT_NORMALIZED", "few": "STRING_CATEGORICAL", "some": "STRING_CATEGORICAL", "many": "STRING_CATEGORICAL", "words": "TEXT", "day": "DATE"}
    got = advisor.auto_configure(df, types, ["t"])
    kind = {c: a.get("distribution", a.get("encoding")) for c, a in got["features"].items()}
    assert kind == {"flat": "constant", "heavy": "heavy_tailed", "skewed": kind["skewed"], "none": "sparse", "wave": "periodic", "few": "one_hot", "some": "embedding", "many": "hashing", "words": None, "day": None}
    assert got["features"]["many"]["salt"] == "0" and got["features"]["day"]["extract"][0] == "month" and got["global"]["heads"] == 2
    scope = {}
    exec(got["snippet"], scope)
    made = scope["pipeline"].fit(df).transform(df, "concat")
    assert made.filter("features is not null").count() == n
    inferred = advisor.auto_configure(df)["types"]
    assert (inferred["few"], inferred["words"], inferred["day"], inferred["heavy"]) == ("STRING_CATEGORICAL", "TEXT", "DATE", "FLOAT_NORMALIZED")


def test_analysis_of_a_file(spark, tmp_path):
    df = from_memory(spark, {"x": [float(i % 7) ** 3 for i in range(60)], "c": list("abcdef") * 10})
    data, types, out, kept = (str(tmp_path / n) for n in ("data", "types.json", "advice.json", "stats.json"))
    write_csv(df, data)
    with open(types, "w") as f:
        json.dump({"x": "numeric", "c": "Categorical", "z": "no such"}, f)
    assert advisor.read_types(types, ["FLOAT_NORMALIZED", "STRING_CATEGORICAL"]) == {"x": "FLOAT_NORMALIZED", "c": "STRING_CATEGORICAL", "z": "FLOAT_NORMALIZED"}
    analyze.main([data, "--output", out, "--stats", kept])
    with open(out) as f:
        found = json.load(f)
    assert set(found["features"]) == {"x", "c"} and "Pipeline([" in found["snippet"]
    with open(kept) as f:
        assert json.load(f)["x"]["count"] == 60
    with pytest.raises(SystemExit):
        analyze.main([data, "--output", out])


def test_rows_in_memory(spark):
    assert rows(from_memory(spark, {"a": 1, "b": "x"}), "a") == [(1, "x")]
    assert rows(from_memory(spark, {"a": [1, 2], "b": np.array([3.0, 4.0])}), "a") == [(1, 3.0), (2, 4.0)]


def test_inference_helpers(sales):
    late = sales.filter("day > '2024-01-04'")
    got = inference.incremental(sales.filter("day <= '2024-01-04'"), late.filter("store = 'A'"), ["store"], ["day"], 2)
    assert [(r["sales"], r["is_new"]) for r in got.collect()] == [(104, False), (106, False), (108, True)]
    assert inference.checked(sales, ["store"], 5) is sales
    with pytest.raises(ValueError, match="'A'"):
        inference.checked(sales, ["store"], 6)
    assert [r["sales"] for r in inference.ordered(sales, ["store"], ["day"]).collect()][:2] == [100, 102]
    scaled = series.normalised(series.features(sales, "sales", ["store"], ["day"]).withColumn("same", F.lit(3.0)), ["mean", "same"])
    assert rows(scaled.select("store", "mean", "same"), "store") == [("A", 0.0, 0.0), ("B", 1.0, 0.0)]


def test_mutual_information_of_counts(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("b", "y", 1), ("b", "y", 2), (None, "y", 1)], "p string, q string, r int")
    got = {(r["a"], r["b"]): (round(r["mi"], 9), r["interacts"]) for r in advisor.mutual_information(df, ["p", "q", "r"]).collect()}
    assert got[("p", "q")] == (round(float(np.log(2)), 9), True) and got[("p", "r")] == (0.0, False)


def test_features_of_a_series_are_summed_in_its_order(spark):
    rng = np.random.default_rng(2)
    data = {g: [float(v) for v in rng.integers(1, 20_000, 64) / 100] for g in range(20)}
    df = spark.createDataFrame([(g, t, v) for g, x in data.items() for t, v in enumerate(x)], "g int, t int, x double").orderBy(F.desc("t")).repartition(5)
    added = {g: float(np.cumsum(x)[-1]) for g, x in data.items()}
    got = {r["g"]: r for r in series.features(df, "x", ["g"], ["t"]).select("g", "mean", "sum").collect()}
    assert {g: (r["mean"], r["sum"]) for g, r in got.items()} == {g: (s / 64, s) for g, s in added.items()}
    f = Feature("x", "TIME_SERIES", {"group": ["g"], "order": ["t"], "features": ["slope", "mean", "max"]})
    rows_ = Pipeline([f]).fit(df).transform(df, "dict", ["g"]).collect()
    assert len(rows_) == 1280 and all(r["x"][2:] == [added[r["g"]] / 64, max(data[r["g"]])] for r in rows_)
