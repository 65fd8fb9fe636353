"""Declared features, fitted in few jobs and compiled to one projection, with windows and joins only where a feature needs them.

    Pipeline([Feature("value", "FLOAT_NORMALIZED"), Feature("kind", "STRING_CATEGORICAL", {"encoding": "one_hot"})]).fit(df).transform(df)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, replace
from enum import Enum

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfeat.functions import categorical, dates, numeric, text
from loomfeat.operators import arrays, inference, neural, series, stats
from loomfeat.plans import steps as named
from loomfeat.sources.scratch import free, written


class FeatureType(Enum):
    FLOAT = FLOAT_NORMALIZED = "FLOAT_NORMALIZED"
    FLOAT_RESCALED = "FLOAT_RESCALED"
    FLOAT_DISCRETIZED = "FLOAT_DISCRETIZED"
    INTEGER_CATEGORICAL = "INTEGER_CATEGORICAL"
    STRING_CATEGORICAL = "STRING_CATEGORICAL"
    TEXT = "TEXT"
    CROSSES = "CROSSES"
    DATE = "DATE"
    PASSTHROUGH = "PASSTHROUGH"
    TIME_SERIES = "TIME_SERIES"


_CATEGORY = {"encoding", "hash_bins", "salt", "embedding_dim", "seed"}
OPTIONS = {
    "FLOAT_NORMALIZED": {"transform", "lambda", "candidates", "clip", "distribution_aware", "embedding_dim", "num_bins", "seed"}, "FLOAT_RESCALED": {"scale"}, "FLOAT_DISCRETIZED": {"boundaries", "num_bins"},
    "INTEGER_CATEGORICAL": _CATEGORY, "STRING_CATEGORICAL": _CATEGORY, "TEXT": {"vocabulary", "length", "max_tokens", "stop_words", "output", "embedding_dim", "seed"},
    "CROSSES": {"columns", "bins"}, "DATE": {"add_season", "fraction_of_year", "extract"}, "PASSTHROUGH": {"dtype"},
    "TIME_SERIES": {"group", "order", "lags", "rolling_size", "difference_order", "averages", "missing", "missing_size", "wavelet", "fft", "features", "calendar", "parallel", "keep_original", "history"},
}
SCALINGS = ("min_max", "robust", "quantile")  # with statistics of the column
VALUES = {"transform": {*numeric.TRANSFORMS, *SCALINGS, "auto"}, "encoding": {"one_hot", "index", "embedding", "hashing", "hash_embedding"}, "output": {"ids", "multi_hot", "embedding"}, "missing": set(series.STRATEGIES)}
MAX_TOKENS = 20_000  # of a learned vocabulary, the most frequent ones; an option of the feature


@dataclass
class Feature:
    """A column and what becomes of it; ``steps`` (Column to Column, or names of plans.steps) replace the default."""

    name: str
    kind: str
    options: dict = field(default_factory=dict)
    steps: Sequence[Callable[[Column], Column]] = ()

    def __post_init__(self) -> None:
        name = self.kind.value if isinstance(self.kind, FeatureType) else str(self.kind).upper()
        if name not in FeatureType.__members__:
            raise ValueError(f"no such feature type: {self.kind}")
        self.kind = FeatureType[name].value
        unknown = set(self.options) - OPTIONS[self.kind]
        if unknown:
            raise ValueError(f"{self.name}: no such option: {sorted(unknown)}")
        for k, allowed in VALUES.items():
            if k in self.options and self.options[k] not in allowed:
                raise ValueError(f"{self.name}: {k} is one of {sorted(allowed)}, not {self.options[k]!r}")
        if self.kind == "TIME_SERIES" and not (self.options.get("group") and self.options.get("order")):
            raise ValueError(f"{self.name}: a series has a group and a total order")
        for step in self.steps:
            named.made(step)


@dataclass
class Pipeline:
    features: Sequence[Feature]

    def fit(self, df: DataFrame) -> Fitted:
        """One aggregation for all numbers, one stacked job for all vocabularies, one for each learned text vocabulary."""
        features = [f for f in self.features if not f.steps]
        numbers = [f for f in features if f.kind.startswith("FLOAT_")]
        fitted: dict[str, dict] = {}
        aggs = stats.numeric([f.name for f in numbers])
        cuts: dict[str, list[float]] = {}
        for f in numbers:
            if f.kind == "FLOAT_DISCRETIZED" and "num_bins" in f.options:
                cuts[f.name] = [i / f.options["num_bins"] for i in range(1, f.options["num_bins"])]
            elif f.options.get("transform") in ("robust", "auto") or f.options.get("distribution_aware"):
                cuts[f.name] = [0.25, 0.5, 0.75]
        aggs += [F.percentile_approx(F.col(f"`{n}`").cast("double"), q, 10000).alias(f"{n}__q") for n, q in cuts.items() if q]
        if aggs:
            row = df.agg(*aggs).first()
            fitted |= {f.name: row[f.name].asDict() for f in numbers}
            for n, q in cuts.items():
                fitted[n]["quantiles"] = list(row[f"{n}__q"] or []) if q else []
        for f in numbers:
            if f.options.get("transform") == "auto" or f.options.get("distribution_aware"):
                fitted[f.name]["transform"] = self._chosen(f, fitted[f.name])
        tables: dict[str, DataFrame] = {}
        self._vocabularies(df, [f for f in features if f.kind.endswith("CATEGORICAL") and "hash" not in f.options.get("encoding", "one_hot")], fitted, tables)
        for f in features:
            if f.kind == "TEXT":
                words = f.options.get("vocabulary")
                fitted[f.name] = {"vocabulary": text.top_tokens(df, f.name, f.options.get("max_tokens", MAX_TOKENS), f.options.get("stop_words", ())) if words is None else list(words)}
        return Fitted(list(self.features), fitted, tables)

    @staticmethod
    def _chosen(f: Feature, s: dict) -> str:
        return numeric.choose_transform(s["skewness"] or 0.0, (s["kurtosis"] or 3.0) - 3, bool(s["negative"]), (s["zero_ratio"] or 0) > 0, bool(s["bounded01"]), f.options.get("candidates"))

    @staticmethod
    def _vocabularies(df: DataFrame, cats: list[Feature], fitted: dict[str, dict], tables: dict[str, DataFrame]) -> None:
        """Vocabularies up to LITERAL_VOCABULARY are literals; larger ones stay tables (value, index), ranked where they lie."""
        if not cats:
            return
        values = written(stats.distinct_values(df, [f.name for f in cats]))
        sizes = {r["feature"]: r["count"] for r in values.groupBy("feature").count().collect()}
        small = [f.name for f in cats if sizes.get(f.name, 0) <= categorical.LITERAL_VOCABULARY]
        found: dict[str, list[str]] = {}
        for r in values.filter(F.col("feature").isin(small)).collect():
            found.setdefault(r["feature"], []).append(r["value"])
        for f in cats:
            number = f.kind == "INTEGER_CATEGORICAL"
            fitted[f.name] = {"size": sizes.get(f.name, 0)}
            if f.name in small:
                fitted[f.name]["vocabulary"] = sorted(map(int, found.get(f.name, []))) if number else sorted(found.get(f.name, []))
            else:
                own = values.filter(F.col("feature") == f.name).select(F.col("value").cast("long").alias("value") if number else "value")
                tables[f.name] = stats.ranked(own, ["value"], "index")


@dataclass
class Fitted:
    features: list[Feature]
    stats: dict[str, dict]
    tables: dict[str, DataFrame] = field(default_factory=dict)
    blocks: list[dict] = field(default_factory=list)

    def columns(self) -> dict[str, Column]:
        """The expression of each feature: a number, an array of numbers, or as it is; of features that need neither windows nor joins."""
        return {f.name: self._column(f) for f in self.features}

    def _column(self, f: Feature, x: Column | None = None) -> Column:
        o, s = f.options, self.stats.get(f.name, {})
        x = F.col(f"`{f.name}`") if x is None and f.kind != "CROSSES" else x
        if f.steps:
            return named.chain(*f.steps)(x)
        if f.kind == "FLOAT_NORMALIZED":
            return self._number(f, x.cast("double"))
        if f.kind == "FLOAT_RESCALED":
            return numeric.rescale(x.cast("double"), o.get("scale", 1.0))
        if f.kind == "FLOAT_DISCRETIZED":
            edges = o.get("boundaries") or sorted(set(s["quantiles"]))
            return numeric.one_hot(numeric.bucket(x.cast("double"), edges), len(edges) + 1)
        if f.kind.endswith("CATEGORICAL"):
            return self._category(f, x)
        if f.kind == "TEXT":
            return self._text(f, x)
        if f.kind == "CROSSES":
            return numeric.one_hot(categorical.cross([F.col(f"`{c}`") for c in o["columns"]], o["bins"]), o["bins"])
        if f.kind == "DATE":
            return self._date(f, x)
        if f.kind == "TIME_SERIES":
            return x
        return x.cast(o["dtype"]) if "dtype" in o else x

    def _number(self, f: Feature, x: Column) -> Column:
        o, s = f.options, self.stats[f.name]
        if "embedding_dim" in o:
            table = F.array(x)
            return neural.apply(table, "numerical_embedding", o["embedding_dim"], o.get("seed", 0), least=s["min"] or 0.0, most=s["max"] or 1.0, bins=o.get("num_bins", 10))
        kind = o.get("transform")
        shape = s["transform"] if kind == "auto" or o.get("distribution_aware") else kind
        if shape in (None, "quantile"):
            y = x if shape else numeric.zscore(x, s["mean"] or 0.0, s["var"])
        elif shape == "min_max":
            y = numeric.min_max(x, s["min"] or 0.0, s["max"] or 0.0, o.get("clip", False))
        elif shape == "robust":
            low, middle, high = s["quantiles"] or (0.0, 0.0, 0.0)
            y = numeric.robust(x, middle, high - low)
        elif shape in ("box_cox", "yeo_johnson"):
            y = numeric.TRANSFORMS[shape](x, o.get("lambda", 0.5))
        else:
            y = numeric.TRANSFORMS[shape](x)
        if not o.get("distribution_aware"):
            return y
        # the value, its wave, and the kind of the column's distribution as one of numeric.KINDS
        kind = numeric.kind_of(s)  # fit knows neither periods nor peaks, which need an order
        return F.concat(numeric.periodic(y), F.array(*[F.lit(float(k == kind)) for k in numeric.KINDS]))

    def _category(self, f: Feature, x: Column) -> Column:
        o, s = f.options, self.stats.get(f.name, {})
        how, seed = o.get("encoding", "one_hot"), o.get("seed", 0)
        if "hash" in how:
            bins = o.get("hash_bins", 100)
            index = categorical.hash_bucket(x, bins, o.get("salt", ""))
            return numeric.one_hot(index, bins) if how == "hashing" else neural.rows_of(index, neural.Weights(seed)(f"{f.name}.embedding", bins, o.get("embedding_dim", 8)))
        index = x if f.name in self.tables else categorical.lookup(x, s["vocabulary"])
        if how == "index":
            return index
        if how == "embedding":
            return neural.rows_of(index, neural.Weights(seed)(f"{f.name}.embedding", s["size"] + 1, o.get("embedding_dim") or categorical.embedding_size(s["size"])))
        return numeric.one_hot(index, s["size"] + 1)

    def _text(self, f: Feature, x: Column) -> Column:
        """NULL is the empty text, so that a vector of several features stays whole."""
        o, words = f.options, self.stats[f.name]["vocabulary"]
        x = F.coalesce(x.cast("string"), F.lit(""))
        if o.get("output") == "multi_hot":
            return text.multi_hot(x, words)
        ids = text.vectorize(x, words, o.get("length", 35), o.get("stop_words", ()))
        if o.get("output") != "embedding":
            return ids
        table = neural.Weights(o.get("seed", 0))(f"{f.name}.embedding", len(words) + 2, o.get("embedding_dim", 16))
        return arrays.apply(ids, lambda v: table[v.astype(np.int64)].mean(1))

    def _date(self, f: Feature, x: Column) -> Column:
        o = f.options
        d = F.coalesce(dates.parse(x.cast("string")), F.to_date(F.substring(x.cast("string"), 1, 10)))
        parts = [dates.cyclic(d, o.get("fraction_of_year", False))]
        if o.get("add_season"):
            parts.append(dates.season_one_hot(d))
        if o.get("extract"):
            known = dates.calendar(d)
            parts.append(F.array(*[known[k].cast("double") for k in o["extract"]]))
        return F.concat(*parts)

    def _prepared(self, df: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """The table with what windows and joins add, and the expression of each feature over it."""
        made: dict[str, Column] = {}
        for f in self.features:
            if f.name in self.tables:
                name = free(f"__{f.name}_index", df)
                df = categorical.lookup_join(df, f.name, self.tables[f.name], name, self.stats[f.name]["size"])
                made[f.name] = self._column(f, F.col(f"`{name}`"))
            elif f.options.get("transform") == "quantile":
                name, order = free(f"__{f.name}_quantile", df), free("__order", df)
                # equal values by what the whole row holds
                df = stats.rank_to_uniform(df.withColumn(order, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), f.name, order, name).drop(order)
                made[f.name] = self._column(f, F.col(f"`{name}`"))
        for f in self.features:
            if f.kind == "TIME_SERIES" and not f.steps:
                df, numbers, vectors = _series(df, f)
                made[f.name] = F.concat(F.array(*[c.cast("double") for c in numbers]), *vectors)
        return df, {f.name: made.get(f.name) if f.name in made else self._column(f) for f in self.features}

    def transform(self, df: DataFrame, output: str = "dict", keep: Sequence[str] = (), drop_na: bool = False) -> DataFrame:
        """``dict``: a column for each feature; ``concat``: one array ``features`` with numbers, dates and series first, then categories and text.

        ``drop_na`` leaves out the first rows of each series, as many as the longest feature needs, once for the whole output.
        """
        if output not in ("dict", "concat"):
            raise ValueError(f"no such output: {output}")
        df, made = self._prepared(df)
        many = [f for f in self.features if f.kind == "TIME_SERIES"]
        if drop_na and many:
            o = many[0].options
            df = series.trimmed(df, series.window(o["group"], o["order"]), self.required_history() - 1)
        if output == "dict":
            return df.select(*[F.col(c) for c in keep], *[c.alias(n) for n, c in made.items()])
        late = ("CATEGORICAL", "TEXT", "CROSSES")
        order = sorted((f for f in self.features if f.kind != "PASSTHROUGH"), key=lambda f: f.kind.endswith(late))
        arrays_ = {x.name for x in df.select(*[made[f.name].alias(f.name) for f in order]).schema if x.dataType.typeName() == "array"}
        wide = [made[f.name].cast("array<double>") if f.name in arrays_ else F.array(made[f.name].cast("double")) for f in order]
        through = [made[f.name].alias(f.name) for f in self.features if f.kind == "PASSTHROUGH"]
        vector = F.concat(*wide)
        for b in self.blocks:
            vector = neural.apply(vector, **b)
        return df.select(*[F.col(c) for c in keep], *through, vector.alias("features"))

    __call__ = transform

    def with_block(self, block: str, units: int, **options: object) -> Fitted:
        """The same with a learned block (see operators.neural) over the vector of the output "concat", after those it has."""
        if block not in neural.BLOCKS:
            raise ValueError(f"no such block: {block}")
        return replace(self, blocks=[*self.blocks, {"block": block, "units": units, **options}])

    def required_history(self) -> int:
        """Rows that the longest feature of a series needs, its own included."""
        need = 1
        for f in self.features:
            o = f.options
            if f.kind == "TIME_SERIES":
                lags = [k + 1 for k in o.get("lags", ())]
                need = max(need, inference.required_history(lags, o.get("rolling_size", 0), o.get("difference_order", 0) + 1, o.get("averages", ())), o.get("history", 16) if o.get("wavelet") or o.get("fft") else 1)
        return need

    def predict(self, df: DataFrame, output: str = "dict", keep: Sequence[str] = (), drop_na: bool = False) -> DataFrame:
        """transform, after a check that each series has the rows its features need."""
        for f in self.features:
            if f.kind == "TIME_SERIES":
                inference.checked(df, f.options["group"], self.required_history())
        return self.transform(df, output, keep, drop_na)

    def widths(self, df: DataFrame) -> dict[str, int]:
        """How many numbers each feature has, from the rows it makes of one row of the table (of those that need no other rows, of one row alone)."""
        row = self.transform(df.limit(1), "dict").first()
        return {} if row is None else {f.name: len(row[f.name]) if isinstance(row[f.name], list) else 1 for f in self.features}

    def save(self, path: str) -> None:
        """As JSON; vocabularies that are tables lie beside it as Parquet."""
        if any(callable(s) for f in self.features for s in f.steps):
            raise ValueError("features with own functions are code, which is not saved; name steps of plans.steps")
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}.{name}")
        with open(path, "w") as out:
            json.dump({"features": [asdict(f) for f in self.features], "stats": self.stats, "tables": sorted(self.tables), "blocks": self.blocks}, out)

    @classmethod
    def load(cls, path: str, spark: object = None) -> Fitted:
        with open(path) as f:
            x = json.load(f)
        if x.get("tables") and spark is None:
            raise ValueError("vocabularies that are tables are read with a session")
        return cls([Feature(**f) for f in x["features"]], x["stats"], {n: spark.read.parquet(f"{path}.{n}") for n in x.get("tables", ())}, x.get("blocks", []))


def _series(df: DataFrame, f: Feature) -> tuple[DataFrame, list[Column], list[Column]]:
    """(table, numbers, vectors): adds the columns of a series feature; ``parallel`` makes all of them of the original values, else each of what the one before it made."""
    o = f.options
    group, order = list(o["group"]), list(o["order"])
    w = series.window(group, order)
    base = free(f"__{f.name}", df)
    if "missing" in o:
        df = series.fill_missing(df, f.name, group, order, o["missing"], o.get("missing_size", 7), out=base)
        df = df.drop("was_missing") if "was_missing" not in (f.name, *group, *order) else df
    else:
        df = df.withColumn(base, F.col(f"`{f.name}`").cast("double"))
    original, out, vectors = F.col(f"`{base}`"), [], []
    if o.get("keep_original", True):
        out.append(original)
    stages = [
        lambda x: series.lags(x, w, o.get("lags", ())), lambda x: series.rolling(x, w, o["rolling_size"]) if o.get("rolling_size") else {},
        lambda x: {"difference": series.difference(x, w, o["difference_order"])} if o.get("difference_order") else {}, lambda x: series.moving_average(x, w, o["averages"]) if o.get("averages") else {},
    ]
    sources = [original]
    for n, stage in enumerate(stages):
        made = {f"{base}_{n}_{i}_{k}": c for i, x in enumerate(sources) for k, c in stage(x).items()}
        if not made:
            continue
        df = df.withColumns(made)
        columns = [F.col(f"`{k}`") for k in made]
        if o.get("parallel", True):
            out += columns
        else:
            sources, out = columns, [original, *columns] if o.get("keep_original", True) else columns
    if o.get("features"):
        summed = {k: c for k, c in series.totals(original, w).items() if k in o["features"]}
        df = df.withColumns({f"{base}_f_{k}": c for k, c in summed.items()})
        if others := [k for k in o["features"] if k not in summed]:
            whole = series.features(df, base, group, order).select(*[F.col(f"`{g}`").alias(f"{base}_g{i}") for i, g in enumerate(group)], *[F.col(k).alias(f"{base}_f_{k}") for k in others])
            df = df.join(whole, [F.col(f"`{g}`").eqNullSafe(F.col(f"{base}_g{i}")) for i, g in enumerate(group)], "left").drop(*[f"{base}_g{i}" for i in range(len(group))])
        out += [F.col(f"`{base}_f_{k}`") for k in o["features"]]
    if o.get("calendar"):
        known = dates.calendar(F.col(f"`{order[0]}`"))
        out += [known[k] for k in o["calendar"]]
    if o.get("wavelet") or o.get("fft"):
        # of the last rows of the series, zeros where it has not begun
        n, last = o.get("history", 16), F.col(f"`{base}_history`")
        df = df.withColumn(f"{base}_history", F.collect_list(F.coalesce(original, F.lit(0.0))).over(w.rowsBetween(-(n - 1), 0)))
        df = df.withColumn(f"{base}_history", F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(last)), last))
        vectors = ([arrays.wavelet(last, o["wavelet"])] if o.get("wavelet") else []) + ([arrays.fft(last, "power", o["fft"])] if o.get("fft") else [])
    return df, out or [original], vectors


def split(vector: Column, dims: Sequence[int | tuple[int, int]]) -> list[Column]:
    """Consecutive parts of a vector by their lengths, or parts by (start, length)."""
    parts, at = [], 0
    for d in dims:
        start, size = d if isinstance(d, (tuple, list)) else (at, d)
        parts.append(F.slice(vector, start + 1, size))
        at = start + size
    return parts
