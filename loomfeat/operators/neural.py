"""Forward passes of learned blocks over the feature vector, with supplied or seeded weights, in Arrow batches.

Weights are never trained here.  Each row's result depends on that row alone, but for nothing else: there is no
attention between the rows of a batch, which would make results depend on partitions.

Rows are the first axis of every array, but the last in memory: the numbers of a row are few, and operations on runs of
thousands of rows cost a fraction of those on runs of four numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomfeat.operators.arrays import by_length

ROWS = 4096  # of a batch at once, so that what lies between two steps stays in the cache


class Weights:
    """Named matrices; those not supplied are drawn from the seed and their name, as Glorot's uniform."""

    def __init__(self, seed: int = 0, given: dict[str, np.ndarray] | None = None):
        self.seed, self.given = seed, dict(given or {})

    def __call__(self, name: str, rows: int, columns: int) -> np.ndarray:
        if name not in self.given:
            rng = np.random.default_rng([self.seed, *name.encode()])
            bound = (6 / (rows + columns)) ** 0.5
            self.given[name] = rng.uniform(-bound, bound, (rows, columns))
        return self.given[name]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def _norm(x: np.ndarray) -> np.ndarray:
    c = x - x.mean(axis=-1, keepdims=True)
    return c / np.sqrt((c * c).mean(axis=-1, keepdims=True) + 1e-6)


def _last(x: np.ndarray) -> np.ndarray:
    """The rows as the last axis, which they are in memory."""
    return np.moveaxis(x, 0, -1)


def _first(x: np.ndarray) -> np.ndarray:
    return np.moveaxis(x, -1, 0)


def dense(x: np.ndarray, w: Weights, name: str, units: int) -> np.ndarray:
    return _first(w(name, x.shape[-1], units).T @ _last(x))


def _tokens(x: np.ndarray, w: Weights, name: str, units: int) -> np.ndarray:
    """Each feature as a vector of width ``units``."""
    return _first(_last(x)[:, None] * w(name, x.shape[-1], units)[..., None])


def _weighted(share: np.ndarray, each: Sequence[np.ndarray]) -> np.ndarray:
    return sum(share[..., i : i + 1] * y for i, y in enumerate(each))


def gated_linear_unit(x: np.ndarray, w: Weights, units: int, name: str = "glu") -> np.ndarray:
    return dense(x, w, f"{name}.a", units) * _sigmoid(dense(x, w, f"{name}.b", units))


def gated_residual(x: np.ndarray, w: Weights, units: int, name: str = "grn") -> np.ndarray:
    h = dense(x, w, f"{name}.1", units)
    h = dense(np.where(h > 0, h, np.expm1(np.minimum(h, 0))), w, f"{name}.2", units)
    skip = x if x.shape[-1] == units else dense(x, w, f"{name}.skip", units)
    return _norm(skip + gated_linear_unit(h, w, units, f"{name}.glu"))


def variable_selection(x: np.ndarray, w: Weights, units: int, name: str = "vsn") -> np.ndarray:
    """The weights of the features, then their weighted mixture."""
    n = x.shape[-1]
    share = _softmax(gated_residual(x, w, n, f"{name}.w"))
    each = [gated_residual(x[..., i : i + 1], w, units, f"{name}.{i}") for i in range(n)]
    return np.concatenate([share, _weighted(share, each)], axis=-1)


def attention(q: np.ndarray, kv: np.ndarray, w: Weights, units: int, heads: int, name: str = "mha") -> np.ndarray:
    if not q.size:
        return q

    def split(x: np.ndarray, part: str) -> np.ndarray:
        y = _last(dense(x, w, f"{name}.{part}", units))
        return y.reshape(len(y), heads, units // heads, -1)

    a, k, v = split(q, "q"), split(kv, "k"), split(kv, "v")
    share = _softmax(np.stack([(a * y).sum(2) for y in k], axis=1) / (units // heads) ** 0.5, 1)
    y = sum(share[:, j, :, None] * v[j] for j in range(len(v)))
    return dense(_first(y.reshape(len(a), units, -1)), w, f"{name}.o", q.shape[-1])


def transformer(x: np.ndarray, w: Weights, units: int, heads: int = 2, name: str = "tr") -> np.ndarray:
    """A block over the features as tokens of width ``units``, flattened."""
    t = _tokens(x, w, f"{name}.in", units)
    t = _norm(t + attention(t, t, w, units, heads, f"{name}.mha"))
    t = _norm(t + dense(np.maximum(dense(t, w, f"{name}.ff1", 2 * units), 0), w, f"{name}.ff2", units))
    return t.reshape(*x.shape[:-1], -1)


def tabular_attention(x: np.ndarray, w: Weights, units: int, heads: int = 2, context: np.ndarray | None = None, name: str = "ta") -> np.ndarray:
    """Attention between the features of a row, then of the row to those of ``context``, rows that are the same for all.

    The rows of a batch do not attend to each other: which they are depends on partitions.
    """

    def features(v: np.ndarray) -> np.ndarray:
        t = _tokens(v, w, f"{name}.in", units)
        t = _norm(t + attention(t, t, w, units, heads, f"{name}.features"))
        return _norm(t + dense(np.maximum(dense(t, w, f"{name}.ff1", 2 * units), 0), w, f"{name}.ff2", units)).reshape(len(v), -1)

    own = features(x)
    if context is None:
        return own
    others, width = features(np.asarray(context, float)), own.shape[1]
    score = _softmax(dense(own, w, f"{name}.q", units) @ dense(others, w, f"{name}.k", units).T / units**0.5)
    return _norm(own + score @ dense(others, w, f"{name}.v", width))


def multi_resolution(x: np.ndarray, w: Weights, units: int, numeric: int, heads: int = 2, name: str = "mr") -> np.ndarray:
    """The first ``numeric`` features and the others as two streams that attend to themselves and to each other."""
    t = _tokens(x, w, f"{name}.in", units)
    a, b = t[..., :numeric, :], t[..., numeric:, :]
    a, b = (_norm(s + attention(s, s, w, units, heads, f"{name}.{k}")) for k, s in (("num", a), ("cat", b)))
    a = _norm(a + attention(a, b, w, units, heads, f"{name}.cross")) if b.shape[-2] and a.shape[-2] else a
    return np.concatenate([a, b], axis=-2).reshape(*x.shape[:-1], -1)


def mixture(x: np.ndarray, w: Weights, units: int, experts: int = 4, top: int = 0, routing: np.ndarray | None = None, name: str = "moe") -> np.ndarray:
    """Experts by learned or given routing (rows of ``routing`` are shares); ``top`` keeps the strongest only."""
    share = _softmax(dense(x, w, f"{name}.gate", experts)) if routing is None else np.broadcast_to(routing, (*x.shape[:-1], experts))
    if top:
        least = np.sort(share, axis=-1)[..., -top][..., None]
        share = np.where(share >= least, share, 0)
        share = share / share.sum(-1, keepdims=True)
    return _weighted(share, [np.maximum(dense(x, w, f"{name}.{e}", units), 0) for e in range(experts)])


def numerical_embedding(x: np.ndarray, w: Weights, units: int, least: float = 0.0, most: float = 1.0, bins: int = 10, pool: str = "", name: str = "ne") -> np.ndarray:
    """A gate between a perceptron and a table of bins for every feature; ``pool`` mean or max over the features."""
    at = np.clip(np.floor((x - least) / (most - least + 1e-6) * bins), 0, bins - 1).astype(int)
    smooth = dense(np.maximum(dense(x[..., None], w, f"{name}.1", units), 0), w, f"{name}.2", units)
    gate = _sigmoid(w(f"{name}.gate", 1, units))
    y = gate * smooth + (1 - gate) * w(f"{name}.bins", bins, units).T[:, at.T].T
    return y.mean(-2) if pool == "mean" else y.max(-2) if pool == "max" else y.reshape(*x.shape[:-1], -1)


BLOCKS: dict[str, Callable[..., np.ndarray]] = {"glu": gated_linear_unit, "grn": gated_residual, "variable_selection": variable_selection, "transformer": transformer, "tabular_attention": tabular_attention, "multi_resolution": multi_resolution, "moe": mixture, "numerical_embedding": numerical_embedding}


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    y = x * 10.0**digits
    whole = np.trunc(y)
    with np.errstate(invalid="ignore"):
        whole += np.copysign(np.abs(y - whole) >= 0.5, y)
    return np.where(np.isfinite(y), whole / 10.0**digits, x) + 0.0


def apply(vector: Column, block: str, units: int, seed: int = 0, given: dict[str, np.ndarray] | None = None, residual: bool = False, digits: int | None = None, **options: object) -> Column:
    """The block over an array column; NULL and empty give NULL, NULL elements count as 0, rows of other lengths have other weights.

    With ``residual`` the vector is added, through a projection where its width is another; with ``digits`` the numbers
    are rounded in the batch, halves away from zero, and none is a negative zero.
    """
    run_block, drawn = BLOCKS[block], {}

    def part(x: np.ndarray) -> np.ndarray:
        w = drawn.setdefault(x.shape[1], Weights(seed, given))
        y = run_block(x, w, units, **options)
        y = y + (x if x.shape == y.shape else dense(x, w, "residual", y.shape[1])) if residual else y
        return y if digits is None else _rounded(y, digits)

    def kernel(x: np.ndarray) -> np.ndarray:
        parts = (part(np.asfortranarray(x[i : i + ROWS])) for i in range(0, len(x), ROWS))
        first = next(parts)
        out = np.empty((len(x), first.shape[1]))
        out[: len(first)] = first
        for i, y in enumerate(parts, 1):
            out[i * ROWS : i * ROWS + len(y)] = y
        return out

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return by_length(column, kernel)

    return run(vector.cast("array<double>"))


def rows_of(index: Column, table: np.ndarray) -> Column:
    """The row of a weight table for each index; NULL has none."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        at = column.fill_null(0).to_numpy(zero_copy_only=False)
        off = np.arange(len(at) + 1, dtype=np.int32) * table.shape[1]
        return pa.ListArray.from_arrays(pa.array(off), pa.array(table[at].ravel()), mask=column.is_null())

    return run(index.cast("int"))


def stack(columns: Sequence[Column]) -> Column:
    """Vectors as the rows of one matrix."""
    return F.array(*columns)


def unstack(matrix: Column, n: int) -> list[Column]:
    return [F.get(matrix, F.lit(i)) for i in range(n)]


def describe(w: Weights) -> list[dict]:
    """Name, shape and kind of each weight."""
    return [{"name": k, "shape": v.shape, "dtype": str(v.dtype)} for k, v in sorted(w.given.items())]
