"""Time series along rows.  Group and order are mandatory, so that no value leaks between groups; one window serves all
operators of a call, which plan as one exchange and one sort.  The order must be total: add a unique column to it.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomfeat.functions import numeric


def window(group: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*group).orderBy(*order)


def trimmed(df: DataFrame, w: WindowSpec, rows: int) -> DataFrame:
    """Without the first ``rows`` rows of each series: the one filter of a whole output."""
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") > rows).drop("__rn") if rows else df


def lags(x: Column, w: WindowSpec, steps: Sequence[int], fill: float | None = None) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(x, k, fill).over(w) for k in steps}


def rolling(x: Column, w: WindowSpec, size: int, stats: Sequence[str] = ("mean", "std", "min", "max", "sum"), pad: float | None = None) -> dict[str, Column]:
    """Statistics (population deviation) of the last ``size`` rows; ``pad`` where there are fewer."""
    kinds = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum}
    frame, rn = w.rowsBetween(-(size - 1), 0), F.row_number().over(w)
    return {f"rolling_{s}": F.when(rn >= size, kinds[s](x).over(frame)).otherwise(F.lit(pad)) for s in stats}


def strided(df: DataFrame, w: WindowSpec, size: int, stride: int) -> DataFrame:
    """Rows where a full window ends, each ``stride``-th of them."""
    return df.withColumn("__rn", F.row_number().over(w)).filter((F.col("__rn") >= size) & ((F.col("__rn") - size) % stride == 0)).drop("__rn")


def difference(x: Column, w: WindowSpec, order: int = 1) -> Column:
    """The ``order``-th difference by its binomial form: one window, no nesting."""
    out, c = x, 1
    for k in range(1, order + 1):
        c = -c * (order - k + 1) // k
        out = out + c * F.lag(x, k).over(w)
    return out


def moving_average(x: Column, w: WindowSpec, periods: Sequence[int], expanding: bool = True) -> dict[str, Column]:
    """Trailing means, aligned by row; the first rows have the mean of what there is, or NULL."""
    rn = F.row_number().over(w)
    mean = {p: F.avg(x).over(w.rowsBetween(-(p - 1), 0)) for p in periods}
    return {f"ma_{p}": m if expanding else F.when(rn >= p, m) for p, m in mean.items()}


def decompose(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str], period: int, multiplicative: bool = False) -> DataFrame:
    """Adds trend (centred mean of period // 2 rows each way), seasonal (mean of the phase) and residual."""
    w, h, x = window(group, order), period // 2, F.col(value).cast("double")
    over = lambda a, b: F.try_divide(a, b) if multiplicative else a - b
    df = df.withColumn("trend", F.avg(x).over(w.rowsBetween(-h, h))).withColumn("__phase", (F.row_number().over(w) - 1) % period)
    df = df.withColumn("seasonal", F.avg(over(x, F.col("trend"))).over(Window.partitionBy(*group, "__phase")))
    if multiplicative:
        df = df.withColumn("seasonal", F.try_divide("seasonal", F.avg("seasonal").over(Window.partitionBy(*group))))
    return df.withColumn("residual", over(over(x, F.col("trend")), F.col("seasonal"))).drop("__phase")


STRATEGIES = ("forward", "backward", "linear", "mean", "median", "rolling", "seasonal")


def fill_missing(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str], strategy: str, size: int = 7, mask: float | None = None, out: str = "filled") -> DataFrame:
    """Adds ``out`` and the indicator ``was_missing``; a value is missing if NULL or equal to ``mask``.

    A trailing gap stays in "linear", a leading one takes the next value; "rolling" falls back to the series' mean and
    "seasonal" to "rolling".
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"no such strategy: {strategy}")
    w, x = window(group, order), F.col(value).cast("double")
    x = x if mask is None else F.when(x != mask, x)
    df = df.withColumn("__x", x)
    x = F.col("__x")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*group)
    if strategy == "forward":
        y = F.last(x, True).over(before)
    elif strategy == "backward":
        y = F.first(x, True).over(after)
    elif strategy == "linear":
        df = df.withColumn("__rn", F.row_number().over(w)).withColumn("__at", F.when(x.isNotNull(), F.col("__rn")))
        lo, hi = F.last(x, True).over(before), F.first(x, True).over(after)
        a, b = F.last("__at", True).over(before), F.first("__at", True).over(after)
        y = F.when(lo.isNull(), hi).otherwise(lo + (hi - lo) * F.try_divide(F.col("__rn") - a, b - a))
    elif strategy == "mean":
        y = F.avg(x).over(whole)
    elif strategy == "median":
        y = F.expr(f"percentile(__x, 0.5) over (partition by {', '.join(f'`{g}`' for g in group)})")
    else:
        near = F.coalesce(F.avg(x).over(w.rowsBetween(-(size // 2), size // 2)), F.avg(x).over(whole))
        y = near
        if strategy == "seasonal":
            df = df.withColumn("__phase", (F.row_number().over(w) - 1) % size)
            y = F.coalesce(F.avg(x).over(Window.partitionBy(*group, "__phase")), near)
    return df.withColumn(out, F.coalesce(x, y)).withColumn("was_missing", x.isNull().cast("int")).drop("__x", "__rn", "__at", "__phase")


def autocorrelation(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str], max_lag: int) -> DataFrame:
    """(lag, acf): the correlation with the series ``lag`` rows earlier, averaged over the series that have one."""
    w, x = window(group, order), F.col(value).cast("double")
    shifted = df.select(*group, x.alias("__x"), *[F.lag(x, k).over(w).alias(f"__l{k}") for k in range(1, max_lag + 1)])
    each = shifted.groupBy(*group).agg(*[_corr("__x", f"__l{k}").alias(f"__c{k}") for k in range(1, max_lag + 1)])
    stacked = each.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__c{k}").alias("c")) for k in range(1, max_lag + 1)])).alias("s"))
    return stacked.groupBy("s.lag").agg(F.avg("s.c").alias("acf"))


def _corr(a: str, b: str) -> Column:
    c = F.corr(a, b)
    return F.when(~F.isnan(c), c)


def select_lags(acf: DataFrame, top_k: int = 5, threshold: float | None = None) -> list[int]:
    """Lags of the ``top_k`` greatest absolute autocorrelations, or of all beyond ``threshold`` if there are any; ascending."""
    rows = [(r["lag"], abs(r["acf"])) for r in acf.collect() if r["acf"] is not None]  # max_lag rows
    over = [k for k, a in rows if threshold is not None and a > threshold]
    return sorted(over or [k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:top_k]])


def totals(x: Column, w: WindowSpec) -> dict[str, Column]:
    """Of each row the means, sums and ends of its whole series, added up in the order of the series: the last digit of a floating sum, and so a tie in rounding, depends on it."""
    made = {"mean": F.avg(x), "min": F.min(x), "max": F.max(x), "sum": F.sum(x), "energy": F.sum(x * x), "abs_energy": F.sum(F.abs(x)), "abs_mean": F.avg(F.abs(x))}
    return {k: c.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for k, c in made.items()}


def features(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Statistics of each whole series, one row a group."""
    w, whole, x = window(group, order), Window.partitionBy(*group), F.col(value).cast("double")
    rn, n = F.row_number().over(w), F.count(F.lit(1)).over(whole)
    peak = (x > F.lag(x).over(w)) & (x > F.lead(x).over(w))
    valley = (x < F.lag(x).over(w)) & (x < F.lead(x).over(w))
    summed = totals(x, w)
    rows = df.select(*group, x.alias("x"), (rn - 1).alias("t"), n.alias("n"), *[c.alias(f"__{k}") for k, c in summed.items()], peak.cast("int").alias("peak"), valley.cast("int").alias("valley"))
    n, x, t = F.max("n"), F.col("x"), F.col("t")
    quantiles = {f"quantile_{int(q * 100):02d}": F.percentile("x", F.lit(q)) for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    many = {
        **{k: F.max(f"__{k}") for k in summed}, "std": F.stddev_pop(x), **quantiles,
        "iqr": F.percentile("x", F.lit(0.75)) - F.percentile("x", F.lit(0.25)), "skewness": F.when(F.count(x) > 2, F.coalesce(F.skewness(x), F.lit(0.0))).otherwise(0.0), "kurtosis": F.when(F.count(x) > 3, F.coalesce(F.kurtosis(x), F.lit(0.0))).otherwise(0.0),
        "count_above_mean": F.count_if(x > F.col("__mean")), "count_below_mean": F.count_if(x < F.col("__mean")), "first_max": F.min_by(t, F.struct(-x, t)) / n, "first_min": F.min_by(t, F.struct(x, t)) / n,
        "slope": F.coalesce(F.regr_slope(x, t), F.lit(0.0)), "intercept": F.coalesce(F.regr_intercept(x, t), F.lit(0.0)), "peaks": F.sum("peak") / n, "valleys": F.sum("valley") / n,
    }
    return rows.groupBy(*group).agg(*[F.coalesce(c, F.lit(0.0)).alias(k) if k in ("peaks", "valleys") else c.alias(k) for k, c in many.items()])


def sliding(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int, stride: int = 1, out: str = "window") -> DataFrame:
    """Each row once for each full window of ``size`` rows that holds it; ``out`` is the window's first row, a multiple of ``stride``.

    Grouped by it as well, every operator of this module works on windows.
    """
    w = window(group, order)
    df = df.withColumn("__t", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    t = F.col("__t")
    first = F.greatest(F.ceil((t - (size - 1)) / stride), F.lit(0)).cast("long")
    last = F.least(F.floor(t / stride), F.floor((F.col("__n") - size) / stride)).cast("long")
    return df.filter((F.col("__n") >= size) & (first <= last)).withColumn(out, F.explode(F.sequence(first, last))).withColumn(out, F.col(out) * stride).drop("__t", "__n")


def frequency_features(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str], coefficients: int = 5, lag: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row a group: fft_coef, the first absolute Fourier coefficients of the centred series over their sum, and autocorrelation_lag_k, the sum of c[t] c[t + k] over that of c^2.

    0 beyond the length of the series, for one value and for a constant series; NULL counts as the mean.
    """
    w, whole, x = window(group, order), Window.partitionBy(*group), F.col(value).cast("double")
    rows = df.select(*group, (F.row_number().over(w) - 1).alias("t"), F.count(F.lit(1)).over(whole).alias("n"), F.coalesce(F.when(F.min(x).over(whole) < F.max(x).over(whole), x - F.avg(x).over(whole)), F.lit(0.0)).alias("c"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    w = window(group, [f"__o{i}" for i in range(len(order))])
    c, n = F.col("c"), F.col("n")
    rows = rows.select(*group, "t", "n", "c", *[F.lag(c, k).over(w).alias(f"l{k}") for k in lag])
    # the zeroth is the sum of a centred series, the phase is reduced before it is a float
    angle = lambda k: (F.col("t") * k % n) * (2 * math.pi) / n
    wave = lambda k: F.when(F.max("n") > k, F.sqrt(F.pow(F.sum(c * F.cos(angle(k))), 2) + F.pow(F.sum(c * F.sin(angle(k))), 2))).otherwise(0.0)
    parts = [F.lit(0.0).alias("a0")] + [wave(k).alias(f"a{k}") for k in range(1, coefficients)]
    acf = {k: F.coalesce(F.when(F.sum(c * c) > 0, F.sum(c * F.col(f"l{k}")) / F.sum(c * c)), F.lit(0.0)).alias(f"autocorrelation_lag_{k}") for k in lag}
    each = rows.groupBy(*group).agg(*parts, *acf.values())
    total = sum((F.col(f"a{k}") for k in range(coefficients)), F.lit(0.0))
    coef = F.array(*[F.when(total > 0, F.col(f"a{k}") / total).otherwise(0.0) for k in range(coefficients)])
    return each.select(*group, coef.alias("fft_coef"), *[f"autocorrelation_lag_{k}" for k in lag])


def chain(df: DataFrame, value: str, group: Sequence[str], order: Sequence[str], lag: Sequence[int] = (), rolling_size: int = 0, difference_order: int = 0, averages: Sequence[int] = (), drop_na: bool = False) -> DataFrame:
    """All series features of one column from the original values, over one window; ``drop_na`` trims once for all."""
    w, x = window(group, order), F.col(value).cast("double")
    new = lags(x, w, lag) | (rolling(x, w, rolling_size) if rolling_size else {}) | ({"difference": difference(x, w, difference_order)} if difference_order else {}) | (moving_average(x, w, averages) if averages else {})
    df = df.withColumns({f"{value}_{k}": c for k, c in new.items()})
    need = reduce(max, [*lag, rolling_size - 1, difference_order, *(p - 1 for p in averages)], 0)
    return trimmed(df, w, need) if drop_na else df


def normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column scaled to [0, 1] by its least and greatest value over all rows; constant ones become 0."""
    ends = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{c}{k}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = {c: numeric.min_max(F.col(f"`{c}`").cast("double"), ends[f"{c}lo"] or 0.0, ends[f"{c}hi"] or 0.0) for c in columns}
    return df.withColumns(scaled)
