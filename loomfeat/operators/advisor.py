"""Profiling and advice: from the statistics of a table to a recommended specification."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfeat.functions import text
from loomfeat.functions.categorical import hash_bins
from loomfeat.operators import stats


def infer_types(df: DataFrame) -> DataFrame:
    """(feature, inferred) from one aggregation over all rows."""
    aggs, kinds = [], {}
    for f in df.schema.fields:
        x, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        kinds[f.name] = kind
        aggs.append(F.approx_count_distinct(x.cast("string"), 0.02).alias(f"{f.name}__d"))
        aggs.append(F.count(x).alias(f"{f.name}__n"))
        if kind == "string":
            aggs.append(F.avg(F.coalesce(x.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}"), F.lit(False)).cast("int")).alias(f"{f.name}__date"))
            aggs.append(F.avg(F.size(F.split(x, r"\s+"))).alias(f"{f.name}__w"))
    r = df.agg(*aggs)
    picks = []
    for name, kind in kinds.items():
        d, n = F.col(f"`{name}__d`"), F.col(f"`{name}__n`")
        ratio = F.coalesce(F.try_divide(d, n), F.lit(0.0))
        if kind in ("date", "timestamp", "timestamp_ntz"):
            pick = F.lit("DATE")
        elif kind == "string":
            pick = F.when(F.col(f"`{name}__date`") > 0.9, "DATE").when((ratio > 0.7) & (F.col(f"`{name}__w`") > 3), "TEXT").otherwise("STRING_CATEGORICAL")
        elif kind in ("integer", "long", "short", "byte"):
            pick = F.when((ratio < 0.05) | (d < 20), "INTEGER_CATEGORICAL").otherwise("FLOAT_NORMALIZED")
        else:
            pick = F.lit("FLOAT_NORMALIZED")
        picks.append(F.struct(F.lit(name).alias("feature"), pick.alias("inferred")))
    return r.select(F.explode(F.array(*picks)).alias("p")).select("p.*")


def detect_distribution(s: Mapping[str, Column] | None = None) -> Column:
    """The kind of distribution by a ladder over the columns of an aggregate row (zero_ratio, skewness, kurtosis with 3 for a normal one, ...)."""
    c = s or {k: F.col(k) for k in ("zero_ratio", "unique_ratio", "skewness", "kurtosis", "negative", "bounded01", "periodic", "multimodal")}
    skew, kurt = c["skewness"], c["kurtosis"]
    return (
        F.when(c["zero_ratio"] > 0.5, "sparse").when(c["periodic"], "periodic").when(c["unique_ratio"] < 0.1, "discrete").when(c["bounded01"] & (F.abs(skew) > 0.5), "beta").when(c["bounded01"], "uniform")
        .when(~c["negative"] & (skew > 2), "log_normal").when(~c["negative"] & (skew > 1), "exponential").when(~c["negative"] & (skew > 0.5), "gamma").when(kurt > 10, "cauchy").when(kurt > 4, "heavy_tailed").when(c["multimodal"], "multimodal").when(c["zero_ratio"] > 0.3, "zero_inflated").otherwise("normal")
    )


def profile(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> dict[str, dict]:
    """The statistics of each column, all that detect_distribution and advise_numeric read; ``order`` must be total.

    autocorrelation is the greatest one of the lags, bimodality Sarle's coefficient (skewness^2 + 1) / kurtosis.
    """
    row = df.agg(*stats.numeric(columns)).first()
    out = {c: row[c].asDict() for c in columns}
    acf = stats.autocorrelations(df, {c: s["mean"] for c, s in out.items()}, order)
    for c, s in out.items():
        peaks = s["count"] and stats.modes(stats.histogram(df, c, s["min"], s["max"])).first()["multimodal"]
        kurtosis = s["kurtosis"] or 0.0
        s |= {"periodic": stats.periodic(acf[c]), "multimodal": bool(peaks), "autocorrelation": max(acf[c], default=None), "bimodality": (s["skewness"] ** 2 + 1) / kurtosis if kurtosis > 0 else None}
    return out


def advise_numeric(s: Mapping[str, float]) -> dict:
    if s["var"] < 1e-10:
        return {"feature_type": "PASSTHROUGH", "distribution": "constant"}
    skew, excess = s["skewness"] or 0.0, (s["kurtosis"] or 3.0) - 3
    if s["zero_ratio"] > 0.5:
        kind = "sparse"
    elif (s.get("autocorrelation") or 0) > 0.7:
        kind = "periodic"
    elif (s.get("bimodality") or 0) > 0.55:
        kind = "multimodal"
    elif abs(skew) < 0.5 and abs(excess) < 1:
        kind = "normal"
    elif s["var"] < 0.1:
        kind = "uniform"
    elif excess > 1:
        kind = "heavy_tailed"
    else:
        kind = "log_normal" if skew > 1 else "unknown"
    if kind == "uniform":
        out = {"feature_type": "FLOAT_RESCALED", "distribution": kind}
    else:
        shape = {"log_normal": "log", "heavy_tailed": "robust", "sparse": "sqrt"}.get(kind)
        out = {"feature_type": "FLOAT_NORMALIZED", "distribution": kind} | ({"transform": shape} if shape else {"distribution_aware": True} if kind in ("periodic", "multimodal") else {})
    if abs(skew) > 1.5 or abs(excess) > 2:
        n = max(1, int(s["count"]))
        out["advanced"] = {"embedding_dim": min(16, max(4, int(math.log2(n)))), "num_bins": min(100, max(10, int(n**0.5)))}
    elif kind in ("normal", "uniform"):
        out["advanced"] = {"polynomial": 2}
    return out


def advise_categorical(vocabulary: int) -> dict:
    if vocabulary < 50:
        return {"encoding": "one_hot"}
    if vocabulary < 100:
        return {"encoding": "embedding", "embedding_dim": min(max(4, vocabulary // 8), 64)}
    bins = hash_bins(vocabulary)
    if vocabulary > 10000:
        return {"encoding": "hash_embedding", "hash_bins": bins, "embedding_dim": min(max(8, bins // 128), 32)}
    return {"encoding": "hashing", "hash_bins": bins}


def salted(advice: Mapping[str, dict]) -> dict[str, dict]:
    """Hashed columns with numbered salts, so that equal values of different columns have other buckets."""
    hashed = [n for n, a in advice.items() if "hash" in a.get("encoding", "")]
    return {n: a | ({"salt": str(hashed.index(n))} if n in hashed else {}) for n, a in advice.items()}


def advise_text(vocabulary: int, mean_length: float) -> dict:
    return {"max_tokens": min(20000, max(1000, vocabulary)), "length": min(200, max(50, int(2 * mean_length))), "output": "embedding", "embedding_dim": min(300, max(16, vocabulary // 100))}


def advise_date(first_year: int | None = None, last_year: int | None = None) -> dict:
    """Parts that vary: a table of one year needs no year, and only one of several has a fraction of the year to tell."""
    several = first_year is None or first_year != last_year
    return {"extract": (["year"] if several else []) + ["month", "day", "day_of_week", "quarter"], "add_season": True, "fraction_of_year": several}


def advise_global(features: int, large: int = 0, hashed: int = 0) -> dict:
    notes = [f"{large} columns have more than 100 values"] if large else []
    notes += [f"{hashed} columns are hashed"] if large and hashed else []
    notes += ["consider hash_embedding for the hashed columns"] if hashed >= 3 else []
    notes += ["attention between the features is advised"] if features > 5 else []
    return {"output": "concat", "heads": min(8, max(2, features // 4)), "tabular_attention": features > 5, "notes": notes}


def advise(df: DataFrame, types: Mapping[str, str], order: Sequence[str] | None = None) -> dict:
    """{"features": {column: advice}, "global": advice} from statistics over all rows, by the type of each column.

    ``order``, if the rows have a total one, lets periods of numeric columns be found.
    """
    of = lambda *kinds: [c for c, t in types.items() if t in kinds]
    numbers, cats, words, days = of("FLOAT_NORMALIZED", "FLOAT_RESCALED", "FLOAT_DISCRETIZED"), of("INTEGER_CATEGORICAL", "STRING_CATEGORICAL"), of("TEXT"), of("DATE")
    out: dict[str, dict] = {}
    if numbers:
        known = profile(df, numbers, order) if order else {c: s.asDict() for c, s in zip(numbers, df.agg(*stats.numeric(numbers)).first(), strict=True)}
        out |= {c: advise_numeric(s) for c, s in known.items()}
    sizes: dict[str, int] = {}
    if cats:
        row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(c) for c in cats]).first()
        sizes = {c: row[c] for c in cats}
        out |= salted({c: {"feature_type": types[c], **advise_categorical(sizes[c])} for c in cats})
    for c in words:
        row = text.record(df, c).first()
        out[c] = {"feature_type": "TEXT", **advise_text(row["size"], row["mean_length"] or 0.0)}
    if days:
        row = df.agg(*[f(F.year(F.to_date(F.substring(F.col(f"`{c}`").cast("string"), 1, 10)))).alias(f"{c}{k}") for c in days for k, f in (("lo", F.min), ("hi", F.max))]).first()
        out |= {c: {"feature_type": "DATE", **advise_date(row[f"{c}lo"], row[f"{c}hi"])} for c in days}
    out |= {c: {"feature_type": "PASSTHROUGH"} for c in of("PASSTHROUGH")}
    hashed = sum("hash" in a.get("encoding", "") for a in out.values())
    return {"features": {c: out[c] for c in types if c in out}, "global": advise_global(len(out), sum(n > 100 for n in sizes.values()), hashed)}


def auto_configure(df: DataFrame, types: Mapping[str, str] | None = None, order: Sequence[str] | None = None) -> dict:
    """Types (those given, else inferred), advice for each column and the whole, and Python that builds the advised pipeline."""
    types = dict(types) if types is not None else {r["feature"]: r["inferred"] for r in infer_types(df).collect()}
    advice = advise(df, types, order)
    return {"types": types, **advice, "snippet": snippet(advice["features"])}


ALIASES = {"NUMERIC": "FLOAT_NORMALIZED", "NUMERICAL": "FLOAT_NORMALIZED", "FLOAT": "FLOAT_NORMALIZED", "CATEGORICAL": "STRING_CATEGORICAL"}


def read_types(path: str, known: Sequence[str]) -> dict[str, str]:
    """{column: type} of a JSON file; short names are known, and what is not one of ``known`` is a number."""
    with open(path) as f:
        given = {k: ALIASES.get(str(v).upper(), str(v).upper()) for k, v in json.load(f).items()}
    return {k: v if v in known else "FLOAT_NORMALIZED" for k, v in given.items()}


def rare_values(df: DataFrame, column: str, share: float = 0.001) -> DataFrame:
    """One row: distinct values, those rarer than ``share`` of the rows, their ratio and whether extra buckets are advised."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    r = counts.crossJoin(F.broadcast(total)).agg(F.count("*").alias("distinct"), F.count_if(F.col("n") < share * F.col("total")).alias("rare"))
    return r.select("distinct", "rare", F.coalesce(F.try_divide("rare", "distinct"), F.lit(0.0)).alias("rare_ratio")).withColumn("oov_buckets", F.col("rare_ratio") > 0.1)


def interactions(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """(a, b, corr, interacts) of all pairs, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(F.col(f"`{a}`").cast("double"), F.col(f"`{b}`").cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]))
    return r.select(rows.alias("p")).select("p.*").withColumn("interacts", F.abs("corr") > threshold)


def mutual_information(df: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """(a, b, mi, interacts) of all pairs of categorical columns, in nats, from their joint counts; rows that lack one of both do not count."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    value = lambda c: F.col(f"`{c}`").cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), value(a).alias("x"), value(b).alias("y")) for a, b in pairs]))
    joint = df.select(each.alias("p")).select("p.*").filter("x is not null and y is not null").groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    # the entropies of both and of the pair are sums over counts
    term = lambda n: F.sum(n * F.ln(n))
    one = joint.groupBy("a", "b", "x").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(term(F.col("n")).alias("sx"))
    two = joint.groupBy("a", "b", "y").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(term(F.col("n")).alias("sy"))
    both = joint.groupBy("a", "b").agg(F.sum("n").alias("t"), term(F.col("n")).alias("s"))
    mi = F.ln("t") + (F.col("s") - F.col("sx") - F.col("sy")) / F.col("t")
    return both.join(one, ["a", "b"]).join(two, ["a", "b"]).select("a", "b", mi.alias("mi")).withColumn("interacts", F.col("mi") > threshold)


def snippet(advice: Mapping[str, Mapping]) -> str:
    """Python that builds the advised pipeline; what is only a hint stands in comments."""
    lines = ["from loomfeat.plans.pipeline import Feature, Pipeline", "", "pipeline = Pipeline(["]
    for name, a in advice.items():
        options = {k: v for k, v in a.items() if k not in ("feature_type", "distribution", "advanced")}
        hint = "  # " + ", ".join(f"{k} {v}" for k, v in a["advanced"].items()) if a.get("advanced") else ""
        lines.append(f"    Feature({name!r}, {a['feature_type']!r}, {options!r}),{hint}")
    return "\n".join([*lines, "])"])
