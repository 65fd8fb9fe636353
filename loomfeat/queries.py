"""One query for each operator, over whole tables, and the same in DuckDB's SQL wherever that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat import forward
from loomfeat.functions import categorical, dates, numeric, text
from loomfeat.operators import advisor, arrays, inference, neural, series, stats
from loomfeat.plans.pipeline import Feature, Pipeline, split

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
TAU = "(2*3.141592653589793)"
SERIES = (["user_id"], ["ts", "event_id"])
W = "partition by user_id order by ts, event_id"


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(x: Column) -> Column:
    """Rounded, since the order of floating sums is free; no negative zero."""
    return F.round(x, DIGITS) + F.lit(0.0)


def rs(x: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0"


def ra(x: Column) -> Column:
    return F.transform(x, r)


def rounded(columns: dict[str, Column]) -> list[Column]:
    return [r(c).alias(k) for k, c in columns.items()]


EVENT_KINDS = "(select list(event_type order by event_type) from (select distinct event_type from events where event_type is not null))"


@query(f"""with s as (select avg(value) m, var_samp(value) v from events), k as (select {EVENT_KINDS} as kinds)
select event_id, list_transform(list_concat([(value - m) / greatest(sqrt(v), 1e-7)],
 [0.0, 1.0, sin({TAU}*month(ts)/12), cos({TAU}*month(ts)/12), sin({TAU}*day(ts)/31), cos({TAU}*day(ts)/31), sin({TAU}*dayofweek(ts)/7), cos({TAU}*dayofweek(ts)/7)],
 list_transform(range(0, len(kinds) + 1), lambda i: case when i = coalesce(list_position(kinds, event_type), 0) then 1.0 else 0.0 end)), lambda x: {rs('x')}) as features from events, s, k""")
def concat_output(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: fit and transform of a number, a date and a category to one vector."""
    df = table(spark, d, "events")
    features = [Feature("event_type", "STRING_CATEGORICAL"), Feature("value", "FLOAT_NORMALIZED"), Feature("ts", "DATE")]
    return Pipeline(features).fit(df).transform(df, "concat", ["event_id"]).select("event_id", ra(F.col("features")).alias("features"))


@query("""with s as (select avg(p_retailprice) m, var_samp(p_retailprice) v from part), k as (select list(b order by b) as kinds from (select distinct p_brand b from part where p_brand is not null))
select p_partkey, """ + rs("(p_retailprice - m) / greatest(sqrt(v), 1e-7)") + """ as p_retailprice, coalesce(list_position(kinds, p_brand), 0)::int as p_brand, p_size * 0.5::double as p_size, p_name from part, s, k""")
def dict_output(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    features = [Feature("p_retailprice", "FLOAT"), Feature("p_brand", "STRING_CATEGORICAL", {"encoding": "index"}), Feature("p_size", "FLOAT_RESCALED", {"scale": 0.5}), Feature("p_name", "PASSTHROUGH")]
    return Pipeline(features).fit(df).transform(df, "dict", ["p_partkey"]).withColumn("p_retailprice", r(F.col("p_retailprice")))


@query("select vec_id, embedding[1:16]::double[] as a, embedding[17:64]::double[] as b from embeddings")
def split_vector(spark: SparkSession, d: str) -> DataFrame:
    a, b = split(F.col("embedding").cast("array<double>"), [16, 48])
    return table(spark, d, "embeddings").select("vec_id", a.alias("a"), b.alias("b"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _skew(x: str, t: str) -> str:
    return f"(select avg(pow(({x} - m) / sd, 3)) from {t}, (select avg({x}) m, stddev_pop({x}) sd from {t}))"


@query(" union all ".join(f"select '{c}' as feature, {rs(f'avg({c})')} as mean, {rs(f'coalesce(var_samp({c}), 0)')} as var, count({c}) as n, min({c}) as min, max({c}) as max, {rs(_skew(c, 'lineitem'))} as skewness, {rs(f'kurtosis_pop({c}) + 3')} as kurtosis, {rs(f'avg((abs({c}) < 1e-10)::int)')} as zero_ratio, bool_or({c} < 0) as negative, bool_and({c} between 0 and 1) as bounded01 from lineitem" for c in NUMBERS))
def numeric_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of all columns from one aggregation."""
    one = table(spark, d, "lineitem").agg(*stats.numeric(NUMBERS))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("s")) for c in NUMBERS]))
    s = lambda k: F.col(f"p.s.{k}")
    return one.select(rows.alias("p")).select("p.feature", r(s("mean")).alias("mean"), r(s("var")).alias("var"), s("count").alias("n"), s("min").alias("min"), s("max").alias("max"), r(s("skewness")).alias("skewness"), r(s("kurtosis")).alias("kurtosis"), r(s("zero_ratio")).alias("zero_ratio"), s("negative").alias("negative"), s("bounded01").alias("bounded01"))


@query("select 'p_brand' as feature, p_brand as value from part where p_brand is not null group by 2 union all select 'p_size', p_size::varchar from part where p_size is not null group by 2 union all select 'p_type', p_type from part where p_type is not null group by 2")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return stats.distinct_values(table(spark, d, "part"), ["p_brand", "p_size", "p_type"])


def _tokens(x: str) -> str:
    return rf"""list_filter(string_split(regexp_replace(regexp_replace(lower({x}), '{text.PUNCTUATION.replace("'", "''")}', ' ', 'g'), '\s+', ' ', 'g'), ' '), lambda t: t <> '')"""


@query(f"select t as token, count(*) as n from (select unnest({_tokens('text')}) as t from documents) group by 1")
def text_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return text.vocabulary(table(spark, d, "documents"), "text")


def _parts() -> dict[str, str]:
    return {"year": "year(o_orderdate)", **{f"{n}_{f}": f"{f}({TAU}*{v}/{p})" for n, v, p in (("month", "month(o_orderdate)", 12), ("dow", "dayofweek(o_orderdate)", 7)) for f in ("sin", "cos")}}


@query("select " + ", ".join(f"{rs(f'avg({v})')} as mean_{k}, {rs(f'coalesce(var_samp({v}), 0)')} as var_{k}" for k, v in _parts().items()) + " from orders")
def date_stats(spark: SparkSession, d: str) -> DataFrame:
    row = table(spark, d, "orders").agg(*stats.date_parts(F.col("o_orderdate")))
    return row.select(*[r(F.col(c)).alias(c) for c in row.columns])


@query(f"""with g as (select user_id, avg(value) m, count(value) n from events group by 1), t as (select sum(n * m) / sum(n) mm from g)
select {rs('max(mm)')} as mean, {rs('sum(n * (m - mm) * (m - mm)) / (sum(n) - 1)')} as var, {rs('(select var_samp(value) from events)')} as total_var, sum(n)::bigint as count, count(*) as num_groups from g, t""")
def group_series_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.grouped(table(spark, d, "events"), "value", ["user_id"])
    return s.select(r(F.col("mean")).alias("mean"), r(F.col("var")).alias("var"), r(F.col("total_var")).alias("total_var"), "count", "num_groups")


@query("""with e as (select min(c_acctbal) lo, max(c_acctbal) hi from customer), h as (select least(floor((c_acctbal - lo) / greatest(hi - lo, 1e-12) * 100), 99)::int b, count(*) n from customer, e where c_acctbal is not null group by 1),
f as (select i.range b, coalesce(n, 0) n from range(100) i left join h on h.b = i.range), s as (select b, coalesce(lag(n) over (order by b), 0) + n + coalesce(lead(n) over (order by b), 0) as s from f),
p as (select s > coalesce(lag(s) over (order by b), -1) and s > coalesce(lead(s) over (order by b), -1) and s > 0.1 * max(s) over () as peak from s) select count(*) filter (where peak) as peaks, count(*) filter (where peak) >= 2 as multimodal from p""")
def multimodality(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    ends = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    return stats.modes(stats.histogram(df, "c_acctbal", ends[0] or 0.0, ends[1] or 0.0))


@query(f"select {', '.join(f'{rs(f"quantile_cont(c_acctbal, {q})")} as q{int(q * 100)}' for q in (0.25, 0.5, 0.75))} from customer")
def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    shares = (0.25, 0.5, 0.75)
    found = spark.createDataFrame([tuple(stats.percentiles(table(spark, d, "customer"), "c_acctbal", shares))], "a double, b double, c double")
    return found.select(*[r(F.col(c)).alias(f"q{int(q * 100)}") for c, q in zip("abc", shares, strict=True)])


LK = "l_orderkey, l_linenumber"


@query(f"with s as (select avg(l_extendedprice) m, var_samp(l_extendedprice) v from lineitem) select {LK}, {rs('(l_extendedprice - m) / greatest(sqrt(v), 1e-7)')} as z, {rs('l_extendedprice * 0.01')} as scaled from lineitem, s")
def zscore_rescale(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    s = df.agg(F.avg("l_extendedprice"), F.var_samp("l_extendedprice")).first()
    x = F.col("l_extendedprice")
    return df.select(*LK.split(", "), r(numeric.zscore(x, s[0] or 0.0, s[1] or 0.0)).alias("z"), r(numeric.rescale(x, 0.01)).alias("scaled"))


@query(f"""select {LK}, (l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 40)::int as bucket, list_transform(range(0, 4), lambda i: case when i = (l_quantity >= 10)::int + (l_quantity >= 20)::int + (l_quantity >= 40)::int then 1.0 else 0.0 end)::double[] as one_hot from lineitem""")
def discretize(spark: SparkSession, d: str) -> DataFrame:
    b = numeric.bucket(F.col("l_quantity"), [10, 20, 40])
    return table(spark, d, "lineitem").select(*LK.split(", "), b.alias("bucket"), numeric.one_hot(b, 4).alias("one_hot"))


@query(f"with q as (select quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) e, min(l_extendedprice) lo, max(l_extendedprice) hi from lineitem) select {LK}, (l_extendedprice >= e[1])::int + (l_extendedprice >= e[2])::int + (l_extendedprice >= e[3])::int as quantile_bin, greatest(0, least(9, floor((l_extendedprice - lo) / (hi - lo + 1e-6) * 10)))::int as uniform_bin from lineitem, q")
def learned_bins(spark: SparkSession, d: str) -> DataFrame:
    df, x = table(spark, d, "lineitem"), F.col("l_extendedprice")
    *edges, least, most = stats.percentiles(df, "l_extendedprice", (0.25, 0.5, 0.75, 0.0, 1.0))
    return df.select(*LK.split(", "), numeric.bucket(x, [e for e in edges if e is not None]).alias("quantile_bin"), numeric.uniform_bin(x, least or 0.0, most or 0.0, 10).alias("uniform_bin"))


_X = "c_acctbal"
_SHAPES = {
    "none": _X, "log": f"case when {_X} > -1e-10 then ln({_X} + 1e-10) end", "sqrt": f"sqrt(greatest({_X}, 0) + 1e-10)", "box_cox": f"(pow(greatest({_X}, 1e-10), 0.5) - 1) / 0.5", "yeo_johnson": f"case when {_X} >= 0 then (pow({_X} + 1, 0.5) - 1) / 0.5 else -(pow(1 - least({_X}, 0), 1.5) - 1) / 1.5 end",
    "arcsinh": f"asinh({_X})", "cube_root": f"sign({_X}) * pow(abs({_X}) + 1e-10, 1.0/3)", "logit": f"ln(least(greatest({_X}, 1e-10), 1 - 1e-10) / (1 - least(greatest({_X}, 1e-10), 1 - 1e-10)))",
}


def _r4(x: str) -> str:
    return f"round({x}, 4) + 0.0"


@query("with s as (select min(c_acctbal) lo, max(c_acctbal) hi, quantile_cont(c_acctbal, 0.5) md, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) iqr from customer) select c_custkey, " + ", ".join(f"{_r4(x)} as {k}" for k, x in _SHAPES.items()) + f", {_r4('(c_acctbal - lo) / (hi - lo)')} as min_max, {_r4('(c_acctbal - md) / iqr')} as robust from customer, s")
def distribution_transforms(spark: SparkSession, d: str) -> DataFrame:
    df, x = table(spark, d, "customer"), F.col(_X)
    *q, least, most = stats.percentiles(df, _X, (0.25, 0.5, 0.75, 0.0, 1.0))
    made = {k: f(x, 0.5) if k in ("box_cox", "yeo_johnson") else f(x) for k, f in numeric.TRANSFORMS.items()} | {"min_max": numeric.min_max(x, least, most), "robust": numeric.robust(x, q[1], q[2] - q[0])}
    return df.select("c_custkey", *[(F.round(c, 4) + 0.0).alias(k) for k, c in made.items()])


@query(f"select c_custkey, {rs('2 * (row_number() over (order by c_acctbal, c_custkey) - 0.5) / count(*) over () - 1')} as quantile from customer")
def quantile_transform(spark: SparkSession, d: str) -> DataFrame:
    return stats.rank_to_uniform(table(spark, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", r(F.col("quantile")).alias("quantile"))


@query(f"select l_orderkey, l_linenumber, {rs('l_discount')} as z, {rs('sin(l_discount * 3.14159)')} as s, {rs('cos(l_discount * 3.14159)')} as c, {rs('case when l_quantity is not null then (dense_rank() over (order by l_quantity nulls last) - 1) / greatest((select count(distinct l_quantity) from lineitem) - 1, 1) end')} as discrete from lineitem")
def distribution_aware(spark: SparkSession, d: str) -> DataFrame:
    """Periodic waves, and discrete values spread over [0, 1] by a join with their ranks."""
    df = stats.dense(table(spark, d, "lineitem"), "l_quantity", "discrete")
    p = numeric.periodic(numeric.sparse_snap(F.col("l_discount")))
    return df.select(*LK.split(", "), r(p[0]).alias("z"), r(p[1]).alias("s"), r(p[2]).alias("c"), r(F.col("discrete")).alias("discrete"))


def _detected(c: str) -> str:
    """The ladder of one column; periods by products of rows that lie 1 to 20 apart, peaks by the smoothed histogram."""
    lag = ", ".join(f"lag(c, {k}) over (order by {LK}) l{k}" for k in range(1, 21))
    acf = "[" + ", ".join(f"case when {k} <= n // 3 then sum(c * l{k}) / sum(c * c) end" for k in range(1, 21)) + "]"
    return f"""select '{c}' as feature, case when zero > 0.5 then 'sparse' when peaks > 0 then 'periodic' when uniq < 0.1 then 'discrete' when b01 and abs(skew) > 0.5 then 'beta' when b01 then 'uniform' when not neg and skew > 2 then 'log_normal' when not neg and skew > 1 then 'exponential'
when not neg and skew > 0.5 then 'gamma' when kurt > 10 then 'cauchy' when kurt > 4 then 'heavy_tailed' when modes > 1 then 'multimodal' when zero > 0.3 then 'zero_inflated' else 'normal' end as distribution,
case when b01 then case when abs(skew) > 0.5 then 'logit' else 'min_max' end when abs(skew) < 0.5 and abs(kurt - 3) < 1 then 'none' when neg then case when abs(skew) > 1 then 'yeo_johnson' else 'arcsinh' end when zero > 0 then case when skew < 2 then 'sqrt' else 'yeo_johnson' end when skew > 2 then 'log' when skew > 0.5 then 'box_cox' else 'sqrt' end as transform from
(select avg((abs({c}) < 1e-10)::int) zero, count(distinct {c}) / count({c})::double uniq, {_skew(c, 'lineitem')} skew, kurtosis_pop({c}) + 3 kurt, bool_or({c} < 0) neg, bool_and({c} between 0 and 1) b01 from lineitem),
(select count(*) peaks from (select unnest(range(1, 21)) k, a from (select list_transform({acf}, lambda v: coalesce(v, -1e9)) a from (select *, {lag} from (select {LK}, {c} - avg({c}) over () c, count({c}) over () n from lineitem where {c} is not null)) group by n)) where a[k] > greatest(coalesce(a[k - 1], -1e9), coalesce(a[k + 1], -1e9), 0.2)),
(with e as (select min({c}) lo, max({c}) hi from lineitem), h as (select least(floor(({c} - lo) / greatest(hi - lo, 1e-12) * 100), 99)::int b, count(*) n from lineitem, e where {c} is not null group by 1), f as (select i.range b, coalesce(n, 0) n from range(100) i left join h on h.b = i.range),
s as (select b, coalesce(lag(n) over (order by b), 0) + n + coalesce(lead(n) over (order by b), 0) as s from f), p as (select s > coalesce(lag(s) over (order by b), -1) and s > coalesce(lead(s) over (order by b), -1) and s > 0.1 * max(s) over () as peak from s) select count(*) filter (where peak) modes from p)"""


@query(" union all ".join(map(_detected, NUMBERS)))
def detect_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Kind of distribution and chosen transform of each column (approximate distinct counts)."""
    row = advisor.profile(table(spark, d, "lineitem"), NUMBERS, LK.split(", "))
    kinds = {"zero_ratio": "double", "unique_ratio": "double", "skewness": "double", "kurtosis": "double", "negative": "boolean", "bounded01": "boolean", "periodic": "boolean", "multimodal": "boolean"}
    rows = spark.createDataFrame([(c, *(row[c][k] for k in kinds)) for c in NUMBERS], "feature string, " + ", ".join(f"{k} {v}" for k, v in kinds.items()))
    chosen = {c: numeric.choose_transform(row[c]["skewness"] or 0.0, (row[c]["kurtosis"] or 3.0) - 3, bool(row[c]["negative"]), (row[c]["zero_ratio"] or 0) > 0, bool(row[c]["bounded01"])) for c in NUMBERS}
    return rows.select("feature", advisor.detect_distribution().alias("distribution"), F.element_at(F.create_map(*[F.lit(y) for kv in chosen.items() for y in kv]), F.col("feature")).alias("transform"))


@query(f"""with k as (select {EVENT_KINDS} as kinds), i as (select event_id, coalesce(list_position(kinds, event_type), 0)::int as idx, len(kinds) as n from events, k)
select event_id, idx as index, list_transform(range(0, n + 1), lambda i: case when i = idx then 1.0 else 0.0 end)::double[] as one_hot, list_transform(range(0, 4), lambda j: round((idx + 1) / (j + 2.0), 6))::double[] as embedded from i""")
def lookup_one_hot_embedding(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "events")
    v = [x[0] for x in df.select("event_type").filter("event_type is not null").distinct().orderBy("event_type").collect()]
    i = categorical.lookup(F.col("event_type"), v)
    weights = [[round((k + 1) / (j + 2), 6) for j in range(4)] for k in range(len(v) + 1)]
    return df.select("event_id", i.alias("index"), numeric.one_hot(i, len(v) + 1).alias("one_hot"), categorical.embed(i, weights).alias("embedded"))


@query("with v as (select c_name, row_number() over (order by c_name) i from (select distinct c_name from customer where c_name is not null)) select c_custkey, coalesce(i, 0)::bigint as index from customer left join v using (c_name)")
def lookup_large(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary beyond a literal: ranked without a global window, then joined."""
    df = table(spark, d, "customer")
    names = df.filter("c_name is not null").select(F.col("c_name").alias("value")).distinct()
    index = stats.ranked(names, ["value"], "index")
    return categorical.lookup_join(df, "c_name", index, "index", names.count()).select("c_custkey", "index")


def _hash(x: str, n: int, salt: str = "") -> str:
    return f"(('0x' || substring(md5('{salt}' || coalesce(({x})::varchar, '')), 1, 8))::bigint % {n})::int"


@query(f"select p_partkey, {_hash('p_type', 32, 'a')} as bucket, {_hash("coalesce(p_brand, '') || chr(31) || coalesce(p_size::varchar, '')", 64)} as crossed, list_transform(range(0, 16), lambda i: case when i = {_hash('p_brand', 16)} then 1.0 else 0.0 end)::double[] as multi_hot from part")
def hashing_and_crosses(spark: SparkSession, d: str) -> DataFrame:
    hot = numeric.one_hot(categorical.hash_bucket(F.col("p_brand"), 16), 16)
    return table(spark, d, "part").select("p_partkey", categorical.hash_bucket(F.col("p_type"), 32, "a").alias("bucket"), categorical.cross([F.col("p_brand"), F.col("p_size")], 64).alias("crossed"), hot.alias("multi_hot"))


STOP = ("the", "a", "and", "of")


@query(rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '{text.PUNCTUATION.replace("'", "''")}', ' ', 'g'), '\b(the|a|and|of)\b\s?', ' ', 'g'), '\s+', ' ', 'g') as cleaned from benchmark_docs""".replace("benchmark_docs", "(select item_id as doc_id, text from benchmark)"))
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), text.clean(F.col("text"), STOP).alias("cleaned"))


VOCABULARY = ("data", "the", "time", "people", "and")


@query(f"""with t as (select item_id, {_tokens('text')} as w from benchmark), v as (select {list(VOCABULARY)!r} as v) select item_id, (list_transform(w, lambda x: coalesce(list_position(v, x) + 1, 1)) || list_transform(range(0, 35), lambda i: 0))[1:35]::int[] as ids,
list_transform(v, lambda x: case when list_contains(w, x) then 1.0 else 0.0 end)::double[] as hot, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as bigrams from t, v""")
def text_vectorize(spark: SparkSession, d: str) -> DataFrame:
    x, own = F.col("text"), F.col("own")
    df = table(spark, d, "benchmark").select("item_id", "text", text.tokens(x).alias("own"))
    return df.select("item_id", text.vectorize(x, VOCABULARY, own=own).alias("ids"), text.multi_hot(x, VOCABULARY, own).alias("hot"), text.ngrams(x, 2, own).alias("bigrams"))


@query(rf"""select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '{text.PUNCTUATION.replace("'", "''")}', ' ', 'g'), '\b(the|a|and|of)\b\s?', ' ', 'g'), '\s+', ' ', 'g') as cleaned from documents""")
def text_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text"), STOP).alias("cleaned"))


@query(f"""with t as (select doc_id, text, {_tokens('text')} as w from documents), v as (select {list(VOCABULARY)!r} as v) select doc_id, case when text is not null then (list_transform(w, lambda x: coalesce(list_position(v, x) + 1, 1)) || list_transform(range(0, 35), lambda i: 0))[1:35]::int[] end as ids,
list_transform(v, lambda x: case when list_contains(w, x) then 1.0 else 0.0 end)::double[] as hot, case when len(w) > 1 then list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]) else [] end as bigrams from t, v""")
def text_vectorize_documents(spark: SparkSession, d: str) -> DataFrame:
    x, own = F.col("text"), F.col("own")
    df = table(spark, d, "documents").select("doc_id", "text", text.tokens(x).alias("own"))
    return df.select("doc_id", text.vectorize(x, VOCABULARY, own=own).alias("ids"), text.multi_hot(x, VOCABULARY, own).alias("hot"), text.ngrams(x, 2, own).alias("bigrams"))


@query(f"with w as (select doc_id, unnest({_tokens('text')}) as token from documents), tf as (select doc_id, token, count(*) as tf from w group by all), df as (select token, count(*) as df from tf group by 1) select doc_id, token, tf, df, {rs('tf * (ln((1 + (select count(*) from documents)) / (1 + df)::double) + 1)')} as tf_idf from tf join df using (token)")
def tf_idf(spark: SparkSession, d: str) -> DataFrame:
    return text.tf_idf(table(spark, d, "documents"), "doc_id", "text").withColumn("tf_idf", r(F.col("tf_idf")))


@query(f"""select o_orderkey, o_orderdate::date as day, dayofweek(o_orderdate)::int as dow, [0.0, 1.0, {', '.join(rs(f'{f}({TAU}*{v}/{p})') for v, p in (('month(o_orderdate)', 12), ('day(o_orderdate)', 31), ('dayofweek(o_orderdate)', 7)) for f in ('sin', 'cos'))}]::double[] as cyclic,
case when month(o_orderdate) in (12, 1, 2) then 'winter' when month(o_orderdate) < 6 then 'spring' when month(o_orderdate) < 9 then 'summer' else 'fall' end as season, date_diff('day', date '2000-01-01', o_orderdate::date)::int as since from orders""")
def date_features(spark: SparkSession, d: str) -> DataFrame:
    day = dates.parse(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"), dates.day_of_week(day).alias("dow"), ra(dates.cyclic(day)).alias("cyclic"), dates.season(day).alias("season"), dates.since(day, "2000-01-01").alias("since"))


_D = "o_orderdate"
_CAL = {"year": f"year({_D})", "month": f"month({_D})", "day": f"day({_D})", "day_of_week": f"isodow({_D}) - 1", "day_of_year": f"dayofyear({_D})", "week_of_year": f"week({_D})", "quarter": f"quarter({_D})"}
_EDGE = {
    "is_weekend": f"isodow({_D}) > 5", "is_month_start": f"day({_D}) = 1", "is_month_end": f"{_D}::date = last_day({_D})", "is_quarter_start": f"{_D}::date = date_trunc('quarter', {_D})", "is_quarter_end": f"{_D}::date + 1 = date_trunc('quarter', {_D}::date + 1)",
    "is_year_start": f"dayofyear({_D}) = 1", "is_year_end": f"month({_D}) = 12 and day({_D}) = 31",
}
_NORM = {"year": (2000, 30), "month": (1, 11), "day": (1, 30), "day_of_week": (0, 6), "day_of_year": (1, 365), "week_of_year": (1, 52), "quarter": (1, 3)}


@query("select o_orderkey, " + ", ".join(f"({x})::int as {k}" for k, x in (_CAL | _EDGE).items()) + ", " + ", ".join(f"{rs(f'(({_CAL[k]}) - {a}) / {b}.0')} as {k}_norm" for k, (a, b) in _NORM.items()) + ", " + ", ".join(f"{rs(f'{f}({TAU}*{v}/{dates.PERIODS[k]})')} as {k}_{f}" for k, v in {**{k: x for k, x in _CAL.items() if k not in ("year", "day_of_week")}, "day_of_week": f"isodow({_D})", "hour": f"hour({_D})", "minute": f"minute({_D})", "second": f"second({_D})"}.items() for f in ("sin", "cos")) + " from orders")
def calendar_features(spark: SparkSession, d: str) -> DataFrame:
    x = F.col(_D)
    return table(spark, d, "orders").select("o_orderkey", *[c.cast("int").alias(k) for k, c in dates.calendar(x).items()], *rounded({f"{k}_norm": c for k, c in dates.normalised(x).items()}), *rounded(dates.waves(x)))


_ROLL = {"mean": "avg", "std": "stddev_pop", "min": "min", "max": "max", "sum": "sum"}


@query("select event_id, " + ", ".join(f"lag(value, {k}) over w as value_lag_{k}" for k in (1, 3)) + ", " + ", ".join(f"{rs(f'case when row_number() over w >= 5 then {f}(value) over f end')} as value_rolling_{k}" for k, f in _ROLL.items()) + f", {rs('value - 2 * lag(value) over w + lag(value, 2) over w')} as value_difference, {rs('avg(value) over m3')} as value_ma_3, {rs('avg(value) over m7')} as value_ma_7 from events window w as ({W}), f as ({W} rows 4 preceding), m3 as ({W} rows 2 preceding), m7 as ({W} rows 6 preceding)")
def series_chain(spark: SparkSession, d: str) -> DataFrame:
    """Lags, rolling statistics, second difference and moving averages over one window."""
    out = series.chain(table(spark, d, "events"), "value", *SERIES, lag=[1, 3], rolling_size=5, difference_order=2, averages=[3, 7])
    exact = {"value_lag_1", "value_lag_3"}
    return out.select("event_id", *[F.col(c) if c in exact else r(F.col(c)).alias(c) for c in out.columns if c.startswith("value_")])


@query(f"select event_id, value from (select *, row_number() over ({W}) rn from events) where rn > 3")
def series_drop_na(spark: SparkSession, d: str) -> DataFrame:
    return series.trimmed(table(spark, d, "events"), series.window(*SERIES), 3).select("event_id", "value")


@query(f"select event_id, {rs('m')} as mean from (select event_id, avg(value) over ({W} rows 3 preceding) m, row_number() over ({W}) rn from events) where rn >= 4 and (rn - 4) % 2 = 0")
def rolling_stride(spark: SparkSession, d: str) -> DataFrame:
    df, w = table(spark, d, "events"), series.window(*SERIES)
    return series.strided(df.withColumns(series.rolling(F.col("value"), w, 4, ["mean"])), w, 4, 2).select("event_id", r(F.col("rolling_mean")).alias("mean"))


@query(f"""with t as (select *, avg(value) over ({W} rows between 3 preceding and 3 following) trend, (row_number() over ({W}) - 1) % 7 ph from events), s as (select *, avg(value - trend) over (partition by user_id, ph) seasonal from t)
select event_id, {rs('trend')} as trend, {rs('seasonal')} as seasonal, {rs('value - trend - seasonal')} as residual from s""")
def seasonal_decomposition(spark: SparkSession, d: str) -> DataFrame:
    out = series.decompose(table(spark, d, "events"), "value", *SERIES, period=7)
    return out.select("event_id", *[r(F.col(c)).alias(c) for c in ("trend", "seasonal", "residual")])


_FILL = {
    "forward": "last_value(x ignore nulls) over b", "backward": "first_value(x ignore nulls) over a", "linear": "case when last_value(x ignore nulls) over b is null then first_value(x ignore nulls) over a else last_value(x ignore nulls) over b + (first_value(x ignore nulls) over a - last_value(x ignore nulls) over b) * (rn - last_value(k ignore nulls) over b) / nullif(first_value(k ignore nulls) over a - last_value(k ignore nulls) over b, 0)::double end",
    "mean": "avg(x) over g", "median": "quantile_cont(x, 0.5) over g", "rolling": "coalesce(avg(x) over n, avg(x) over g)", "seasonal": "coalesce(avg(x) over p, avg(x) over n, avg(x) over g)",
}


@query(f"""with v as (select event_id, user_id, ts, case when event_type <> 'click' then value end as x from events), q as (select *, row_number() over ({W}) rn from v), u as (select *, case when x is not null then rn end k, (rn - 1) % 7 ph from q)
select event_id, (x is null)::int as was_missing, {', '.join(f'{rs(f"coalesce(x, {s})")} as {k}' for k, s in _FILL.items())} from u window b as ({W} rows unbounded preceding), a as ({W} rows between current row and unbounded following), g as (partition by user_id), n as ({W} rows between 3 preceding and 3 following), p as (partition by user_id, ph)""")
def missing_values(spark: SparkSession, d: str) -> DataFrame:
    """All seven strategies on series that lack the values of one kind of event."""
    df = table(spark, d, "events").withColumn("x", F.when(F.col("event_type") != "click", F.col("value")))
    for s in series.STRATEGIES:
        df = series.fill_missing(df, "x", *SERIES, s, out=f"_{s}")
    return df.select("event_id", "was_missing", *[r(F.col(f"_{s}")).alias(s) for s in series.STRATEGIES])


@query("with l as (select user_id, value, " + ", ".join(f"lag(value, {k}) over ({W}) l{k}" for k in range(1, 6)) + " from events), c as (select user_id, " + ", ".join(f"case when stddev_pop(value) filter (where l{k} is not null) > 0 and stddev_pop(l{k}) > 0 then corr(value, l{k}) end c{k}" for k in range(1, 6)) + " from l group by 1) " + " union all ".join(f"select {k} as lag, {rs(f'avg(c{k})')} as acf from c" for k in range(1, 6)))
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return series.autocorrelation(table(spark, d, "events"), "value", *SERIES, 5).select("lag", r(F.col("acf")).alias("acf"))


_LAGGED = ", ".join(f"lag(value, {k}) over ({W}) l{k}" for k in range(1, 11))
_ACF = " union all ".join(f"select {k} k, avg(c{k}) a from c" for k in range(1, 11))


@query("with l as (select event_id, user_id, value, " + _LAGGED + " from events), c as (select " + ", ".join(f"case when stddev_pop(value) filter (where l{k} is not null) > 0 and stddev_pop(l{k}) > 0 then corr(value, l{k}) end c{k}" for k in range(1, 11)) + f" from l group by user_id), t as (select k from ({_ACF}) where a is not null order by abs(a) desc, k limit 3), chosen as (select list(k order by k) ks from t) select event_id, list_transform(ks, lambda k: k::int) as lags, list_transform(ks, lambda k: [" + ", ".join(f"l{k}" for k in range(1, 11)) + "][k]) as lagged from l, chosen")
def auto_lags(spark: SparkSession, d: str) -> DataFrame:
    """The three lags of greatest autocorrelation, and the values that far back."""
    df = table(spark, d, "events")
    chosen = series.select_lags(series.autocorrelation(df, "value", *SERIES, 10), top_k=3)
    made = series.lags(F.col("value"), series.window(*SERIES), chosen)
    return df.select("event_id", F.lit(chosen).cast("array<int>").alias("lags"), F.array(*made.values()).alias("lagged"))


_ST = {
    "mean": "avg(x)", "std": "stddev_pop(x)", "min": "min(x)", "max": "max(x)", "sum": "sum(x)", "energy": "sum(x*x)", "abs_energy": "sum(abs(x))", "abs_mean": "avg(abs(x))", **{f"quantile_{int(q * 100):02d}": f"quantile_cont(x, {q})" for q in (0.05, 0.25, 0.5, 0.75, 0.95)}, "iqr": "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)",
    "skewness": "case when count(x) > 2 and stddev_pop(x) > 0 then avg(pow(x - m, 3)) / pow(stddev_pop(x), 3) else 0 end", "kurtosis": "case when count(x) > 3 and stddev_pop(x) > 0 then kurtosis_pop(x) else 0 end", "count_above_mean": "count(*) filter (where x > m)", "count_below_mean": "count(*) filter (where x < m)",
    "first_max": "(arg_max(t, x order by t)) / max(n)::double", "first_min": "(arg_min(t, x order by t)) / max(n)::double", "slope": "coalesce(regr_slope(x, t), 0)", "intercept": "case when count(x) > 1 then regr_intercept(x, t) else 0 end", "peaks": "coalesce(sum(pk), 0) / max(n)::double", "valleys": "coalesce(sum(vl), 0) / max(n)::double",
}


@query(f"with s as (select user_id, value x, row_number() over ({W}) - 1 t, count(*) over (partition by user_id) n, avg(value) over (partition by user_id) m, (value > lag(value) over ({W}) and value > lead(value) over ({W}))::int pk, (value < lag(value) over ({W}) and value < lead(value) over ({W}))::int vl from events) select user_id, " + ", ".join(f"round({x}, 4)::double + 0.0 as {k}" for k, x in _ST.items()) + " from s group by user_id")
def series_features(spark: SparkSession, d: str) -> DataFrame:
    out = series.features(table(spark, d, "events"), "value", *SERIES)
    return out.select("user_id", *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in out.columns if c != "user_id"])


def _frequencies(rows: str, keys: str) -> str:
    """Coefficients and autocorrelations of the rows (keys, x, t, n), by sums of sines and cosines."""
    wave = lambda f, k: f"sum(c * {f}({TAU} * ((t * {k}) % n) / n))"
    a = ", ".join(f"case when max(n) > {k} then sqrt(pow({wave('cos', k)}, 2) + pow({wave('sin', k)}, 2)) else 0 end a{k}" for k in range(1, 5))
    l = ", ".join(f"coalesce(sum(c * l{k}) / nullif(sum(c * c), 0), 0) acf{k}" for k in (1, 2, 3))  # noqa: E741
    return f"""with r as ({rows}), c as (select {keys}, t, n, coalesce(case when min(x) over g < max(x) over g then x - avg(x) over g end, 0) c from r window g as (partition by {keys})),
l as (select *, {', '.join(f'lag(c, {k}) over (partition by {keys} order by t) l{k}' for k in (1, 2, 3))} from c), s as (select {keys}, 0.0 a0, {a}, {l} from l group by {keys})
select {keys}, list_transform([a0, a1, a2, a3, a4], lambda v: {rs('coalesce(v / nullif(a1 + a2 + a3 + a4, 0), 0)')}) as fft_coef, {', '.join(f'{rs(f"acf{k}")} as autocorrelation_lag_{k}' for k in (1, 2, 3))} from s"""


_WHOLE = f"select user_id, value x, row_number() over ({W}) - 1 t, count(*) over (partition by user_id) n from events"
_WINDOWS = f'select user_id, s as "window", x, t - s as t, 20 as n from (select *, unnest([10 * (t // 10), 10 * (t // 10) - 10]) s from ({_WHOLE})) where s >= 0 and s + 20 <= n'


@query(_frequencies(_WHOLE, "user_id"))
def series_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Fourier coefficients and autocorrelations of each whole series."""
    out = series.frequency_features(table(spark, d, "events"), "value", *SERIES)
    return out.select("user_id", ra(F.col("fft_coef")).alias("fft_coef"), *[r(F.col(c)).alias(c) for c in out.columns if c.startswith("autocorrelation")])


_WK = 'user_id, "window"'


@query(f"""with f as ({_frequencies(_WINDOWS, _WK)}), w as (select *, avg(x) over (partition by {_WK}) m, (x > lag(x) over o and x > lead(x) over o)::int pk, (x < lag(x) over o and x < lead(x) over o)::int vl from ({_WINDOWS}) window o as (partition by {_WK} order by t)),
s as (select {_WK}, {', '.join(f'round({x}, 4)::double + 0.0 as {k}' for k, x in _ST.items())} from w group by {_WK}) select * from s join f using ({_WK})""")
def series_window_features(spark: SparkSession, d: str) -> DataFrame:
    """All features of windows of 20 rows, each tenth of them."""
    (group, order), df = SERIES, table(spark, d, "events")
    windows = series.sliding(df, group, order, 20, 10)
    keys = [*group, "window"]
    some, more = series.features(windows, "value", keys, order), series.frequency_features(windows, "value", keys, order)
    some = some.select(*keys, *[(F.round(F.col(c).cast("double"), 4) + 0.0).alias(c) for c in some.columns if c not in keys])
    return some.join(more.select(*keys, ra(F.col("fft_coef")).alias("fft_coef"), *[r(F.col(c)).alias(c) for c in more.columns if c.startswith("auto")]), keys)


@query(f"""with a as (select vec_id, embedding::double[] e from embeddings), b as (select vec_id, e, list_transform(range(1, 64), lambda i: (e[i] + e[i + 1]) / 2) s from a), c as (select *, list_transform(range(1, 61), lambda i: (s[i] + s[i + 1] + s[i + 2] + s[i + 3]) / 4) u from b),
m as (select *, list_avg(e) mu from c) select vec_id, list_transform(list_transform(range(1, 64), lambda i: e[i + 1] - s[i]) || list_transform(range(1, 61), lambda i: s[i + 3] - u[i]) || u, lambda x: {rs('x / 64')}) as wavelet, {rs('list_sum(list_transform(range(1, 63), lambda i: (e[i] - mu) * (e[i + 2] - mu))) / list_sum(list_transform(e, lambda x: (x - mu) * (x - mu)))')} as acf_2 from m""")
def array_wavelet(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", ra(arrays.wavelet(e, 2)).alias("wavelet"), r(arrays.autocorrelation(e, [2])[0]).alias("acf_2"))


@query(f"""with p as (select vec_id, list_transform(range(0, 33), lambda k: pow(list_sum(list_transform(range(0, 64), lambda t: embedding[t + 1]::double * cos({TAU} * k * t / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda t: embedding[t + 1]::double * sin({TAU} * k * t / 64))), 2)) as p from embeddings)
select vec_id, list_transform(p[1:8], lambda x: {rs('x / list_max(p)')}) as power from p""")
def array_fft(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", ra(arrays.fft(F.col("embedding"), "full", 8)).alias("power"))


def _bins(f: str) -> str:
    return f"list_transform(range(0, 33), lambda k: list_sum(list_transform(range(0, 64), lambda t: x[t + 1] * {f}({TAU} * ((k * t) % 64) / 64))))"


@query(f"""with w as (select vec_id, list_transform(range(0, 64), lambda t: embedding[t + 1]::double * (0.5 - 0.5 * cos({TAU} * t / 63))) x from embeddings), z as (select vec_id, {_bins('cos')} re, {_bins('sin')} im from w),
q as (select vec_id, list_transform(range(1, 34), lambda i: re[i] * re[i] + im[i] * im[i]) p, list_transform(range(1, 34), lambda i: atan2(case when i in (1, 33) then 0.0 else 0 - im[i] end, re[i])) ph from z),
u as (select vec_id, list_transform(p, lambda v: v / list_max(p)) p, ph from q), m as (select *, list_avg(p) mu, list_stddev_pop(p) sd, (list_sort(list_transform(range(1, 34), lambda i: struct_pack(o := -p[i], i := i))))[1:4] top from u)
select vec_id, list_transform([p[1], p[11], p[22], p[33]], lambda v: {rs('v')}) as power, flatten(list_transform(top, lambda s: [{rs('p[s.i]')}, {rs('(s.i - 1) / 33.0')}, {rs('ph[s.i]')}])) as dominant,
list_transform([mu, (list_sort(p))[17], sd, list_avg(list_transform(p, lambda v: pow(v - mu, 3))) / (pow(sd, 3) + 1e-10), list_avg(list_transform(p, lambda v: pow(v - mu, 4))) / (pow(sd, 4) + 1e-10) - 3, list_sum(p[1:6]), list_sum(p[7:19]), list_sum(p[20:33])], lambda v: {rs('v')}) as stats from m""")
def array_fft_modes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", *[ra(arrays.fft(e, m, 4, "hann")).alias(m) for m in ("power", "dominant", "stats")])


_INPUTS = dict(zip(("a", "b", "c", "d"), (f"{c} / {s}" for c, s in zip(NUMBERS, (50, "1e5", 0.1, 0.1), strict=True)), strict=True))


@query(forward.sql(LK, _INPUTS, "lineitem", 4, 4))
def neural_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every learned block with seeded weights over a vector of numbers."""
    v = F.array(*[F.col(c) / s for c, s in zip(NUMBERS, (50, 1e5, 0.1, 0.1), strict=True)])
    blocks = {b: neural.apply(v, b, 4, digits=4, **({"numeric": 2} if b == "multi_resolution" else {})) for b in neural.BLOCKS}
    return table(spark, d, "lineitem").select(*LK.split(", "), *[c.alias(k) for k, c in blocks.items()])


def _inferred(c: str, kind: str) -> str:
    rule = {
        "string": f"case when avg(coalesce(regexp_matches({c}, '^\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}'), false)::int) > 0.9 then 'DATE' when count(distinct {c}) / count({c})::double > 0.7 and avg(len(regexp_split_to_array({c}, '\\s+'))) > 3 then 'TEXT' else 'STRING_CATEGORICAL' end",
        "integer": f"case when count(distinct {c}) < 20 or count(distinct {c}) / count({c})::double < 0.05 then 'INTEGER_CATEGORICAL' else 'FLOAT_NORMALIZED' end",
        "double": "max('FLOAT_NORMALIZED')",
    }[kind]
    return f"select '{c}' as feature, {rule} as inferred from part"


_PART = {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "double"}


@query(" union all ".join(_inferred(*x) for x in _PART.items()))
def type_inference(spark: SparkSession, d: str) -> DataFrame:
    return advisor.infer_types(table(spark, d, "part"))


@query("with c as (select p_type, count(*) n from part where p_type is not null group by 1), r as (select count(*) d, count(*) filter (where n < 0.001 * (select sum(n) from c)) k from c) select d as distinct, k as rare, coalesce(k / nullif(d, 0)::double, 0.0) as rare_ratio, coalesce(k / nullif(d, 0)::double, 0.0) > 0.1 as oov_buckets from r".replace("d as distinct", 'd as "distinct"'))
def rare_values(spark: SparkSession, d: str) -> DataFrame:
    return advisor.rare_values(table(spark, d, "part"), "p_type")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, {rs(f'corr({a}, {b})')} as corr, abs(corr({a}, {b})) > 0.7 as interacts from lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def interactions(spark: SparkSession, d: str) -> DataFrame:
    return advisor.interactions(table(spark, d, "lineitem"), list(NUMBERS)).withColumn("corr", r(F.col("corr")))


_BINS = "case when v < 5000 then greatest(v * 3 // 10 * 10, 100) when v < 50000 then greatest(v // 5 // 50 * 50, 1000) else greatest(v // 10 // 100 * 100, 5000) end"
_ADVICE = f"case when v < 50 then 'one_hot' when v < 100 then 'embedding' when v <= 10000 then 'hashing' else 'hash_embedding' end as encoding, case when v >= 100 then {_BINS} end::int as bins, case when v between 50 and 99 then least(greatest(4, v // 8), 64) when v > 10000 then least(greatest(8, ({_BINS}) // 128), 32) end::int as width"
_COUNTED = {"event_type": "events", "user_id": "events", "event_id": "events", "p_name": "part", "o_orderkey": "orders"}


@query("with n as (" + " union all ".join(f"select '{c}' f, count(distinct {c}) v from {t}" for c, t in _COUNTED.items()) + f") select f as feature, v as size, {_ADVICE} from n")
def advise_categorical(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for c, t in _COUNTED.items():
        v = table(spark, d, t).agg(F.count_distinct(c)).first()[0]
        a = advisor.advise_categorical(v)
        rows.append((c, v, a["encoding"], a.get("hash_bins"), a.get("embedding_dim")))
    return spark.createDataFrame(rows, "feature string, size long, encoding string, bins int, width int")


@query("select user_id, count(*) as rows from events group by 1 having count(*) < 70")
def history_check(spark: SparkSession, d: str) -> DataFrame:
    return inference.insufficient(table(spark, d, "events"), ["user_id"], inference.required_history(lags=[1, 7], window_size=21, periods=[70]))


@query("with l as (select user_id, max(ts)::date d from events group by 1) select user_id, (d + i.range::int)::date as ts, true as is_new from l, range(1, 4) i union all select user_id, ts::date, false from events")
def history_and_future(spark: SparkSession, d: str) -> DataFrame:
    """History with the frame of three more days of each series."""
    df = table(spark, d, "events").select("user_id", F.col("ts").cast("date").alias("ts"))
    return inference.combine(df, inference.future(df, ["user_id"], "ts", 3))


_MI = ("p_brand", "p_type", "p_size")


@query(" union all ".join(f"""select '{a}' as a, '{b}' as b, {rs('sum(n / t * ln(n * t / (nx * ny)))')} as mi, sum(n / t * ln(n * t / (nx * ny))) > 0.5 as interacts from
(select n::double n, sum(n) over (partition by {a})::double nx, sum(n) over (partition by {b})::double ny, sum(n) over ()::double t from (select {a}, {b}, count(*) n from part where {a} is not null and {b} is not null group by all))""" for i, a in enumerate(_MI) for b in _MI[i + 1 :]))
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return advisor.mutual_information(table(spark, d, "part"), _MI).withColumn("mi", r(F.col("mi")))


_SHAPE = "case when var < 1e-10 then 'constant' when zero > 0.5 then 'sparse' when bim > 0.55 then 'multimodal' when abs(skew) < 0.5 and abs(kurt - 3) < 1 then 'normal' when var < 0.1 then 'uniform' when kurt > 4 then 'heavy_tailed' when skew > 1 then 'log_normal' else 'unknown' end"
_ADVISED = ("l_quantity", "l_extendedprice", "l_tax")


@query(" union all ".join(f"""select '{c}' as feature, case {_SHAPE} when 'constant' then 'PASSTHROUGH' when 'uniform' then 'FLOAT_RESCALED' else 'FLOAT_NORMALIZED' end as feature_type, {_SHAPE} as distribution from
(select var_samp({c}) var, avg((abs({c}) < 1e-10)::int) zero, {_skew(c, 'lineitem')} skew, kurtosis_pop({c}) + 3 kurt, 0 bim from lineitem)""" for c in _ADVISED) + " union all " + " union all ".join(f"select '{c}', 'STRING_CATEGORICAL', case when count(distinct {c}) < 50 then 'one_hot' when count(distinct {c}) < 100 then 'embedding' else 'hashing' end from lineitem" for c in ("l_returnflag", "l_linestatus")) + " union all select 'l_shipdate', 'DATE', null")
def auto_configure(spark: SparkSession, d: str) -> DataFrame:
    """Advice for a table from its statistics."""
    types = {c: "FLOAT_NORMALIZED" for c in _ADVISED} | {"l_returnflag": "STRING_CATEGORICAL", "l_linestatus": "STRING_CATEGORICAL", "l_shipdate": "DATE"}
    got = advisor.auto_configure(table(spark, d, "lineitem"), types)["features"]
    return spark.createDataFrame([(c, a["feature_type"], a.get("distribution", a.get("encoding"))) for c, a in got.items()], "feature string, feature_type string, distribution string")


_SERIES = {"group": SERIES[0], "order": SERIES[1], "lags": [1, 3], "rolling_size": 5, "difference_order": 1, "averages": [3], "features": ["mean", "max"], "calendar": ["month", "day_of_week"]}


@query(f"""with s as (select avg(value) m, var_samp(value) v from events) select event_id, list_transform([(value - m) / greatest(sqrt(v), 1e-7), value, lag(value) over w, lag(value, 3) over w, {', '.join(f'case when row_number() over w >= 5 then {f}(value) over f end' for f in _ROLL.values())},
value - lag(value) over w, avg(value) over m3, avg(value) over g, max(value) over g, month(ts), isodow(ts) - 1]::double[], lambda x: {rs('x')}) as features from events, s window w as ({W}), f as ({W} rows 4 preceding), m3 as ({W} rows 2 preceding), g as (partition by user_id)""")
def pipeline_series(spark: SparkSession, d: str) -> DataFrame:
    """A number and a series of the same table in one vector."""
    df = table(spark, d, "events").withColumn("series", F.col("value"))
    made = Pipeline([Feature("value", "FLOAT_NORMALIZED"), Feature("series", "TIME_SERIES", _SERIES)]).fit(df).transform(df, "concat", ["event_id"])
    return made.select("event_id", ra(F.col("features")).alias("features"))


@query(f"""with w as (select doc_id, {_tokens('text')} as w from documents), n as (select t, count(*) n from (select unnest(w) t from w) group by 1 order by n desc, t limit 50), v as (select list(t order by n desc, t) v from n)
select doc_id, (list_transform(coalesce(w, []), lambda x: coalesce(list_position(v, x) + 1, 1)) || list_transform(range(0, 35), lambda i: 0))[1:35]::int[] as text from w, v""")
def text_learned_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent tokens of a column become its vocabulary."""
    df = table(spark, d, "documents")
    return Pipeline([Feature("text", "TEXT", {"max_tokens": 50})]).fit(df).transform(df, "dict", ["doc_id"])


@query(f"""with q as (select quantile_disc(c_acctbal, [0.25, 0.5, 0.75]) q, min(c_acctbal) lo, max(c_acctbal) hi from customer), v as (select c_name, row_number() over (order by c_name) i from (select distinct c_name from customer where c_name is not null))
select c_custkey, {_r4('(c_acctbal - q[2]) / (q[3] - q[1])')} as a, {_r4('(c_acctbal - lo) / (hi - lo)')} as b, {_r4('2 * (row_number() over (order by c_acctbal nulls last) - 0.5) / count(c_acctbal) over () - 1')} as c, coalesce(i, 0)::bigint as c_name from customer left join v using (c_name), q""")
def pipeline_scalings(spark: SparkSession, d: str) -> DataFrame:
    """Transforms with statistics of the column, and the index in a vocabulary that is a table where it is large."""
    df = table(spark, d, "customer").select("c_custkey", "c_name", *[F.col("c_acctbal").alias(k) for k in "abc"])
    made = Pipeline([Feature("a", "FLOAT", {"transform": "robust"}), Feature("b", "FLOAT", {"transform": "min_max"}), Feature("c", "FLOAT", {"transform": "quantile"}), Feature("c_name", "STRING_CATEGORICAL", {"encoding": "index"})]).fit(df).transform(df, "dict", ["c_custkey"])
    return made.select("c_custkey", *[(F.round(k, 4) + 0.0).alias(k) for k in "abc"], F.col("c_name").cast("long").alias("c_name"))


_EMBEDDED = neural.Weights(0)("p_type.embedding", 32, 4)


@query(f"select p_partkey, list_transform(([{', '.join(str([float(x) for x in row]) for row in _EMBEDDED)}]::double[][])[1 + {_hash('p_type', 32, 'a')}], lambda x: {rs('x')}) as p_type from part")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part")
    made = Pipeline([Feature("p_type", "STRING_CATEGORICAL", {"encoding": "hash_embedding", "hash_bins": 32, "salt": "a", "embedding_dim": 4})]).fit(df).transform(df, "dict", ["p_partkey"])
    return made.select("p_partkey", ra(F.col("p_type")).alias("p_type"))


@query("select sum(len(w))::bigint as tokens, (select count(distinct t) from (select unnest(w) t from w)) as size, least((select count(distinct t) from (select unnest(w) t from w)), 10000) as vocab_size, round(avg(len(w)), 6) + 0.0 as mean_length, 100 as sequence_length from w".replace("select sum", f"with w as (select {_tokens('text')} as w from documents) select sum", 1))
def text_record(spark: SparkSession, d: str) -> DataFrame:
    return text.record(table(spark, d, "documents"), "text").withColumn("mean_length", r(F.col("mean_length")))


@query(f"with n as (select max(event_id) - 100 as cut from events), h as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) rn from events, n where event_id <= cut) select event_id, user_id, value, false as is_new from h where rn <= 5 and user_id in (select user_id from events, n where event_id > cut) union all select event_id, user_id, value, true from events, n where event_id > cut")
def incremental_history(spark: SparkSession, d: str) -> DataFrame:
    """New rows with the last five rows of history of their series."""
    df = table(spark, d, "events").select("event_id", "user_id", "value", "ts")
    cut = df.agg(F.max("event_id") - 100).first()[0]
    return inference.incremental(df.filter(F.col("event_id") <= cut), df.filter(F.col("event_id") > cut), *SERIES, need=5).drop("ts")


@query("with f as (select user_id, avg(value) m, max(value) x from events group by 1) select user_id, " + ", ".join(f"{rs(f'({c} - min({c}) over ()) / nullif(max({c}) over () - min({c}) over (), 0)')} as {n}" for c, n in (("m", "mean"), ("x", "max"))) + " from f")
def normalised_features(spark: SparkSession, d: str) -> DataFrame:
    out = series.normalised(series.features(table(spark, d, "events"), "value", *SERIES), ["mean", "max"])
    return out.select("user_id", r(F.col("mean")).alias("mean"), r(F.col("max")).alias("max"))
