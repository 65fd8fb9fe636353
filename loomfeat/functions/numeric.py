"""Numeric column transforms: pure Column to Column, so that Catalyst keeps them in one projection.

NULL gives NULL throughout; a formula outside its domain (log of a value below -EPS) gives NULL as well.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def zscore(x: Column, mean: float, variance: float) -> Column:
    return (x - F.lit(mean)) / F.lit(max(variance**0.5, 1e-7))


def _known(x: Column, y: Column) -> Column:
    """NULL where ``x`` is: greatest and least take the other value."""
    return F.when(x.isNotNull(), y)


def rescale(x: Column, scale: float = 1.0) -> Column:
    return x * F.lit(float(scale))


def bucket(x: Column, boundaries: Sequence[float]) -> Column:
    """How many boundaries are at most ``x``."""
    at_most = [F.when(x >= b, 1).otherwise(0) for b in sorted(boundaries)]
    return F.when(x.isNotNull(), sum(at_most, F.lit(0)))


def uniform_bin(x: Column, least: float, most: float, bins: int) -> Column:
    at = F.floor((x - least) / F.lit(most - least + 1e-6) * bins)
    return _known(x, F.greatest(F.lit(0), F.least(F.lit(bins - 1), at)).cast("int"))


def one_hot(index: Column, depth: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.when(i == index, 1.0).otherwise(0.0))


def log(x: Column) -> Column:
    return F.when(x > -EPS, F.ln(x + EPS))


def sqrt(x: Column) -> Column:
    return _known(x, F.sqrt(F.greatest(x, F.lit(0.0)) + EPS))


def box_cox(x: Column, lam: float = 0.0) -> Column:
    positive = F.greatest(x, F.lit(EPS))
    return _known(x, F.ln(positive) if abs(lam) < EPS else (F.pow(positive, F.lit(float(lam))) - 1) / lam)


def yeo_johnson(x: Column, lam: float = 1.0) -> Column:
    up = F.ln(x + 1) if abs(lam) < EPS else (F.pow(x + 1, F.lit(float(lam))) - 1) / lam
    down = -F.ln(1 - x) if abs(lam - 2) < EPS else -(F.pow(1 - x, F.lit(2.0 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(F.when(x < 0, down))


def arcsinh(x: Column) -> Column:
    return F.asinh(x)


def cube_root(x: Column) -> Column:
    return F.signum(x) * F.pow(F.abs(x) + EPS, F.lit(1 / 3))


def logit(x: Column) -> Column:
    p = F.least(F.greatest(x, F.lit(EPS)), F.lit(1 - EPS))
    return _known(x, F.ln(p / (1 - p)))


def min_max(x: Column, least: float, most: float, clip: bool = False) -> Column:
    """To [0, 1] by the fitted or configured ends; a constant column gives 0."""
    y = (x - F.lit(least)) / F.lit(most - least) if most > least else x * 0.0
    return _known(x, F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))) if clip else y


def robust(x: Column, median: float, iqr: float) -> Column:
    return (x - F.lit(median)) / F.lit(max(iqr, EPS))


def sparse_snap(x: Column, eps: float = EPS) -> Column:
    return F.when(F.abs(x) < eps, 0.0).otherwise(x)


def periodic(z: Column, frequency: float = 1.0, phase: float = 0.0) -> Column:
    angle = z * frequency * 3.14159 + phase
    return F.array(z, F.sin(angle), F.cos(angle))


#: The parameterless and one-parameter transforms by the name that a spec uses.
TRANSFORMS = {"none": lambda x: x, "log": log, "sqrt": sqrt, "box_cox": box_cox, "yeo_johnson": yeo_johnson, "arcsinh": arcsinh, "cube_root": cube_root, "logit": logit}


KINDS = ("sparse", "periodic", "discrete", "beta", "uniform", "log_normal", "exponential", "gamma", "cauchy", "heavy_tailed", "multimodal", "zero_inflated", "normal")


def kind_of(s: Mapping[str, object]) -> str:
    """The kind of distribution by a ladder over statistics (zero_ratio, skewness, kurtosis with 3 for a normal one, ...); those that are not there say no."""
    zero, unique, skew, kurt = (s.get(k) or d for k, d in (("zero_ratio", 0.0), ("unique_ratio", 1.0), ("skewness", 0.0), ("kurtosis", 3.0)))
    bounded, positive = bool(s.get("bounded01")), not s.get("negative")
    rules = (zero > 0.5, s.get("periodic"), unique < 0.1, bounded and abs(skew) > 0.5, bounded, positive and skew > 2, positive and skew > 1, positive and skew > 0.5, kurt > 10, kurt > 4, s.get("multimodal"), zero > 0.3, True)
    return next(k for k, holds in zip(KINDS, rules, strict=True) if holds)


def choose_transform(skewness: float, excess_kurtosis: float, negative: bool, zeros: bool, bounded01: bool, candidates: Sequence[str] | None = None) -> str:
    """The transform for a distribution; of ``candidates`` only, if given.  Bounded values come before non-negative ones."""
    if bounded01:
        ranked = ["logit" if abs(skewness) > 0.5 else "min_max"]
    elif abs(skewness) < 0.5 and abs(excess_kurtosis) < 1:
        ranked = ["none"]
    elif negative:
        ranked = ["yeo_johnson" if abs(skewness) > 1 else "arcsinh", "robust", "cube_root"]
    elif zeros:
        ranked = ["sqrt" if skewness < 2 else "yeo_johnson", "cube_root"]
    else:
        ranked = ["log" if skewness > 2 else "box_cox" if skewness > 0.5 else "sqrt"]
    allowed = [t for t in ranked if candidates is None or t in candidates]
    return allowed[0] if allowed else (list(candidates)[0] if candidates else "none")
