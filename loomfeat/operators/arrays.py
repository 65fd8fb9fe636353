"""Series that lie in an array column of each row.  Kernels run in Arrow batches: nested higher-order
functions evaluate their inner arrays again for every element."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def by_length(column: pa.Array, kernel: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """The kernel over the rows of each length at once; NULL and empty arrays give NULL, NULL elements count as 0."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    width, parts = np.zeros(len(column), np.int64), []
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        own = column if len(at) == len(column) else column.take(pa.array(at))
        made = kernel(own.flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, n))
        width[at] = made.shape[1]
        parts.append((at, made))
    off = np.r_[0, np.cumsum(width)]
    flat = np.empty(off[-1])
    for at, made in parts:
        if len(at) == len(column):
            flat = made.ravel()
        else:
            flat[(off[at][:, None] + np.arange(made.shape[1])).ravel()] = made.ravel()
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat), mask=pa.array(sizes == 0))


def apply(a: Column, kernel: Callable[[np.ndarray], np.ndarray]) -> Column:
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return by_length(column, kernel)

    return run(a.cast("array<double>"))


def wavelet(a: Column, levels: int = 2, keep: str = "all") -> Column:
    """Details of each level and the last approximation, over the length; ``keep``: all, approximation or details."""

    def kernel(x: np.ndarray) -> np.ndarray:
        n, parts = x.shape[1], []
        for level in range(1, levels + 1):
            size = min(2**level, max(1, n // 2), x.shape[1])
            total = np.concatenate([np.zeros((len(x), 1)), x.cumsum(1)], axis=1)
            smooth = (total[:, size:] - total[:, :-size]) / size
            parts.append(x[:, size - 1 :] - smooth)
            x = smooth
        return np.concatenate({"all": [*parts, x], "approximation": [x], "details": parts}[keep], axis=1) / n

    return apply(a, kernel)


def autocorrelation(a: Column, lags: Sequence[int]) -> Column:
    """For each lag the sum of c[t] c[t + k] over the sum of c^2, for the centred series; 0 for a constant one."""

    def kernel(x: np.ndarray) -> np.ndarray:
        c = x - x.mean(1, keepdims=True)
        square = (c * c).sum(1)
        each = [(c[:, : max(0, c.shape[1] - k)] * c[:, k:]).sum(1) for k in lags]
        return np.stack([np.divide(e, square, out=np.zeros(len(x)), where=square > 0) for e in each], axis=1)

    return apply(a, kernel)


def _rfft(x: np.ndarray, window: str = "none") -> np.ndarray:
    taper = {"none": np.ones, "hann": np.hanning, "hamming": np.hamming}[window](x.shape[1])
    return np.fft.rfft(x * taper, axis=1)


def _power(z: np.ndarray) -> np.ndarray:
    p = np.abs(z) ** 2
    return p / np.maximum(p.max(axis=1, keepdims=True), 1e-12)


def spectrum(x: np.ndarray, window: str = "none") -> np.ndarray:
    """Power of the real FFT of each row over the row's maximum."""
    return _power(_rfft(x, window))


def fft(a: Column, mode: str = "power", k: int = 8, window: str = "none") -> Column:
    """"power": k evenly spaced bins; "full": the first k; "dominant": (power, bin over the number of bins, phase) of each of the k strongest;
    "stats": mean, upper median, deviation, skewness, excess kurtosis, and the energy of the bins up to a fifth, up to three fifths, and beyond."""

    def kernel(x: np.ndarray) -> np.ndarray:
        z = _rfft(np.nan_to_num(x), window)
        p = _power(z)
        bins = p.shape[1]
        if mode == "power":
            return p[:, np.linspace(0, bins - 1, min(k, bins)).astype(int)]
        if mode == "full":
            return p[:, :k]
        if mode == "dominant":
            top = np.argsort(-p, axis=1, kind="stable")[:, :k]
            return np.stack([np.take_along_axis(p, top, 1), top / bins, np.take_along_axis(np.angle(z), top, 1)], axis=2).reshape(len(p), -1)
        mean, std = p.mean(1), p.std(1)
        c = p - mean[:, None]
        low, mid = int(bins * 0.2), int(bins * 0.6)
        shape = [(c**3).mean(1) / (std**3 + 1e-10), (c**4).mean(1) / (std**4 + 1e-10) - 3]
        return np.stack([mean, np.sort(p, axis=1)[:, bins // 2], std, *shape, p[:, :low].sum(1), p[:, low:mid].sum(1), p[:, mid:].sum(1)], 1)

    return apply(a, kernel)
