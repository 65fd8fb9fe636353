"""The fit pass: statistics in one aggregation for all columns, vocabularies in one stacked job."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfeat.sources.scratch import free, written


def numeric(columns: Sequence[str]) -> list[Column]:
    """mean, var (0 for one value), count, min, max, skewness, kurtosis (3 for a normal one), zero and unique ratio, flags."""
    out = []
    for c in columns:
        x = F.col(f"`{c}`").cast("double")
        out += [
            F.struct(
                F.avg(x).alias("mean"), F.coalesce(F.var_samp(x), F.lit(0.0)).alias("var"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis"),
                F.avg((F.abs(x) < 1e-10).cast("int")).alias("zero_ratio"), F.try_divide(F.approx_count_distinct(x, 0.02), F.count(x)).alias("unique_ratio"), F.bool_or(x < 0).alias("negative"), F.bool_and((x >= 0) & (x <= 1)).alias("bounded01"),
            ).alias(c)
        ]
    return out


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) of all columns from one scan and one shuffle; values as text, NULL left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()


def date_parts(d: Column) -> list[Column]:
    """Mean and variance of year, and of sine and cosine of month and weekday."""
    tau = 2 * 3.141592653589793
    parts = {"year": F.year(d).cast("double")}
    for name, v, period in (("month", F.month(d), 12), ("dow", F.dayofweek(d) - 1, 7)):
        parts |= {f"{name}_sin": F.sin(v * (tau / period)), f"{name}_cos": F.cos(v * (tau / period))}
    return [c for k, v in parts.items() for c in (F.avg(v).alias(f"mean_{k}"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias(f"var_{k}"))]


def grouped(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """One row: mean weighted by counts, variance of the replicated group means, total variance, count, number of groups.

    The second aggregation is over partial sums of the groups; only scalars leave the executors.
    """
    x = F.col(f"`{value}`").cast("double")
    each = df.groupBy(*group).agg(F.avg(x).alias("m"), F.count(x).alias("n"), F.sum(x * x).alias("q"))
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("m"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m"))
    return each.agg(
        F.try_divide(s, n).alias("mean"), F.coalesce(F.try_divide(between - s * s / n, n - 1), F.lit(0.0)).alias("var"), F.coalesce(F.try_divide(F.sum("q") - s * s / n, n - 1), F.lit(0.0)).alias("total_var"), n.alias("count"), F.count("*").alias("num_groups")
    )


COLLECTED = 20_000  # rows of a bracket from which its distinct values are collected


def percentiles(df: DataFrame, column: str, shares: Sequence[float], collected: int = COLLECTED) -> list[float | None]:
    """Exact percentiles with linear interpolation, NULL left out; of no values None.

    F.percentile merges all distinct values in one task.  Here each rank that is needed lies between two values, which
    come nearer in each round: approximate percentiles of the rows between propose two values about the rank, rows below
    and up to them are counted, and so the bracket holds the rank whatever the approximation was worth.  Only states of
    fixed size and at last the values of brackets of up to ``collected`` rows leave the tasks.
    """
    x = F.col(f"`{column}`").cast("double")
    known, x = df.select(x.alias("x")).filter("x is not null and not isnan(x)"), F.col("x")
    n, least, most = known.agg(F.count("x"), F.min("x"), F.max("x")).first()
    count = n + df.select(F.count_if(F.isnan(F.col(f"`{column}`").cast("double")))).first()[0]  # NaN is beyond all others
    if not count:
        return [None] * len(shares)
    places = [(count - 1) * q for q in shares]
    # rank from 0: [least value, greatest value, rows below, rows between]
    open_ = {k: [least, most, 0, n] for p in places for k in (math.floor(p), math.ceil(p)) if k < n}
    within = lambda b: (x >= b[0]) & (x <= b[1])
    done: dict[int, float] = {k: math.nan for p in places for k in (math.floor(p), math.ceil(p)) if k >= n}
    done |= {0: least, n - 1: most} if n else {}
    while True:
        done |= {k: b[0] for k, b in open_.items() if b[0] == b[1]}
        open_ = {k: b for k, b in open_.items() if k not in done}
        wide = {k: b for k, b in open_.items() if b[3] > collected}
        if not wide:
            break
        near = {k: [min(max((k - b[2] + d * b[3] / 500) / b[3], 0.0), 1.0) for d in (-1, 1)] for k, b in wide.items()}
        shared: dict[tuple, list[int]] = {}  # one state for the ranks of a bracket
        for k, b in wide.items():
            shared.setdefault((b[0], b[1]), []).append(k)
        found = known.agg(*[F.percentile_approx(F.when(within(b), x), [q for k in ks for q in near[k]], 1000).alias(f"c{i}") for i, (b, ks) in enumerate(shared.items())]).first()
        cuts = {k: found[i][2 * j : 2 * j + 2] for i, ks in enumerate(shared.values()) for j, k in enumerate(ks)}
        counted = known.agg(*[F.count_if(c).alias(f"{k}_{i}") for k in wide for i, c in enumerate((x < cuts[k][0], x <= cuts[k][0], x < cuts[k][1], x <= cuts[k][1]))]).first()
        inner = {}
        for k, b in wide.items():
            (low, high), (l0, l1, h0, h1) = cuts[k], (counted[f"{k}_{i}"] for i in range(4))
            if l0 <= k < l1:
                open_[k] = [low, low, l0, l1 - l0]
            elif h0 <= k < h1:
                open_[k] = [high, high, h0, h1 - h0]
            else:  # below, above or strictly between the two
                before, after, where = (b[2], l0, x < low) if k < l0 else (h1, b[2] + b[3], x > high) if k >= h1 else (l1, h0, (x > low) & (x < high))
                open_[k] = [*b[:2], before, after - before]
                inner[k] = F.when(within(b) & where, x)
        if inner:
            ends = known.agg(*[f(c).alias(f"{k}_{f.__name__}") for k, c in inner.items() for f in (F.min, F.max)]).first()
            open_ |= {k: [ends[f"{k}_min"], ends[f"{k}_max"], *open_[k][2:]] for k in inner}
    if open_:
        values = known.filter(reduce(or_, map(within, open_.values()))).groupBy("x").count().collect()  # at most ``collected`` a rank
        for k, b in open_.items():
            at = b[2]
            for v, c in sorted((r for r in values if b[0] <= r[0] <= b[1]), key=lambda r: r[0]):
                at += c
                if k < at:
                    done[k] = v
                    break
    ends = [(p, done[math.floor(p)], done[math.ceil(p)]) for p in places]
    return [a if p == math.floor(p) or a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b for p, a, b in ends]


def histogram(df: DataFrame, value: str, least: float, most: float, bins: int = 100) -> DataFrame:
    """(bin, n) of the bins that hold values."""
    x = F.col(f"`{value}`").cast("double")
    at = F.least(F.floor((x - least) / F.lit(max(most - least, 1e-12)) * bins), F.lit(bins - 1)).cast("int")
    return df.filter(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def modes(counts: DataFrame, bins: int = 100, level: float = 0.1) -> DataFrame:
    """One row: number of local peaks of the smoothed histogram above ``level`` of its maximum, and whether there are two.

    Its windows run over ``bins`` rows, whatever the size of the table.
    """
    w = Window.orderBy("bin")
    full = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").na.fill(0, ["n"])
    smooth = full.select("bin", (F.coalesce(F.lag("n").over(w), F.lit(0)) + F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))).alias("s"))
    s = F.col("s")
    peaks = smooth.select(((s > F.coalesce(F.lag(s).over(w), F.lit(-1))) & (s > F.coalesce(F.lead(s).over(w), F.lit(-1))) & (s > level * F.max(s).over(Window.partitionBy()))).alias("peak"))
    return peaks.agg(F.count_if("peak").alias("peaks")).withColumn("multimodal", F.col("peaks") >= 2)


MAX_LAG = 20


def autocorrelations(df: DataFrame, means: Mapping[str, float | None], order: Sequence[str], max_lag: int = MAX_LAG) -> dict[str, list[float]]:
    """Of each column the sums of c[t] c[t + k] over the sum of c^2 for k from 1 to ``max_lag`` (n // 3 at most), over all rows by ``order``.

    Rows are range-partitioned and sorted; each partition sums its own products and hands over its first and last
    ``max_lag`` values, from which come the products across partitions.  NULL and NaN are left out.  Empty for fewer
    than 3 ``max_lag`` values and for constant columns.
    """
    names = list(means)
    kind = "p int, c int, n long, square double, products array<double>, head array<double>, tail array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        n, square, products = [0] * len(names), [0.0] * len(names), np.zeros((len(names), max_lag))
        head, tail = ([np.zeros(0) for _ in names] for _ in range(2))
        for batch in batches:
            for i, name in enumerate(names):
                x = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)] - (means[name] or 0.0)
                both = np.concatenate([tail[i], x])
                for k in range(1, max_lag + 1):
                    late = both[max(k, len(tail[i])) :]
                    products[i, k - 1] += late @ both[len(both) - len(late) - k : len(both) - k]
                n[i], square[i] = n[i] + len(x), square[i] + float(x @ x)
                head[i], tail[i] = np.concatenate([head[i], x[: max_lag - len(head[i])]]), both[-max_lag:]
        rows = [{"p": p, "c": i, "n": n[i], "square": square[i], "products": products[i].tolist(), "head": head[i].tolist(), "tail": tail[i].tolist()} for i in range(len(names)) if n[i]]
        yield from pa.Table.from_pylist(rows, pa.schema([("p", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("square", pa.float64()), *((x, pa.list_(pa.float64())) for x in ("products", "head", "tail"))])).to_batches()

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`").cast("double") for c in names])
    parts = ordered.mapInArrow(run, kind).collect()  # one row a partition and column
    out = {}
    for i, name in enumerate(names):
        mine = sorted((x for x in parts if x["c"] == i), key=lambda x: x["p"])
        n, square, products, last = sum(x["n"] for x in mine), sum(x["square"] for x in mine), np.zeros(max_lag), []
        for x in mine:
            products += x["products"]
            for j, v in enumerate(x["head"]):
                for k in range(j + 1, min(max_lag, j + len(last)) + 1):
                    products[k - 1] += v * last[j - k]
            last = (last + x["tail"])[-max_lag:]
        out[name] = (products[: n // 3] / square).tolist() if n >= 3 * max_lag and square > 1e-12 else []
    return out


def periodic(acf: Sequence[float], threshold: float = 0.2) -> bool:
    """Whether a local peak of the autocorrelations, ends included, is above the threshold."""
    a = [-math.inf, *acf, -math.inf]
    return len(acf) >= 3 and any(a[i] > max(a[i - 1], a[i + 1], threshold) for i in range(1, len(a) - 1))


def ranked(df: DataFrame, by: Sequence[str], out: str = "rank") -> DataFrame:
    """Adds the rank from 1 on by the columns ``by``, nulls last; exact over all rows, and total if ``by`` is unique.

    Rows are range-partitioned by all of ``by``, so that a hot value of the first column is split by the others, sorted
    within the partitions and numbered there; they are written once, since the same rows must be counted and numbered,
    and each partition is shifted by the sizes of those before it, one row a partition.
    """
    place, size = free("__place", df), F.lit(1 << 33)
    order = [F.col(f"`{c}`").asc_nulls_last() for c in by]
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()))
    parts = rows.groupBy(F.floor(F.col(place) / size).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    starts, before = [], 0
    for x in parts:
        starts.append((x["p"], before))
        before += x["n"]
    shift = df.sparkSession.createDataFrame(starts, f"{place}p long, {place}b long")
    joined = rows.join(F.broadcast(shift), F.floor(F.col(place) / size) == F.col(f"{place}p"))
    return joined.withColumn(out, F.col(f"{place}b") + F.col(place) % size + 1).drop(place, f"{place}p", f"{place}b")


def rank_to_uniform(df: DataFrame, value: str, tie: str, out: str = "quantile") -> DataFrame:
    """Adds 2 (r - 0.5) / n - 1 for the rank r by (value, tie) among the n rows with a value; NULL without one."""
    known = F.col(f"`{value}`").isNotNull()
    n = df.filter(known).count()
    rank = free("__rank", df)
    return ranked(df, [value, tie], rank).withColumn(out, F.when(known, 2 * (F.col(rank) - 0.5) / n - 1)).drop(rank)


def dense(df: DataFrame, value: str, out: str, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Adds the place of the value among the distinct ones, spread evenly over [0, 1]; NULL has none.

    The ranks of the distinct values are joined, broadcast up to ``broadcast_rows`` of them.
    """
    key, rank = free("__value", df), free("__rank", df)
    x = F.col(f"`{value}`")
    distinct = df.filter(x.isNotNull()).select(x.alias(key)).distinct()
    places = ranked(distinct, [key], rank)
    n = places.count()
    places = places.withColumn(rank, (F.col(rank) - 1) / max(n - 1, 1))
    joined = df.join(F.broadcast(places) if n <= broadcast_rows else places.hint("merge"), x == F.col(key), "left")
    return joined.withColumn(out, F.col(rank)).drop(key, rank)
