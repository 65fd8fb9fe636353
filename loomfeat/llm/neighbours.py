"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky 2012).

The two halves of the vectors are quantised separately, by K centroids each that Lloyd's steps fit on a sample of SAMPLE_ROWS
vectors, so that K * K cells partition the space; every vector is indexed.  K grows with the root of the table, to
MOST_CENTROIDS, where the table of cells has 32 MB.  A query takes the centroid pairs in the order of their summed distance
from a heap.  First it visits cells until they hold FIRST entries, whose rerank gives the distance of its k-th best so far;
then it goes on until the cells left are expected to hold less than MISS * k nearer entries.  An entry at the residual r
of a cell at the distance D has the squared distance D^2 + r^2 - 2 <q - c, y - c>, where the last term is about normal
with the variance 4 D^2 r^2 / d for unrelated directions, which WIDEN enlarges; so the entries of a cell that are
nearer than the k-th best can be foretold.  Easy queries visit few cells, hard ones as many as their recall needs; there
is no cap.

Queries are the vectors whose vec_id is divisible by ``every``, against all vectors.  Visits are grouped by blocks: the
entries of one first-half centroid, at most about BLOCK of them, which split further by a hash beyond, and about QUERIES
queries of neighbouring centroids.  Each pair of a query block and an entry block that occurs is one task's matrix products,
so that no group grows with the table.

Defined results: every distinct vec_id divisible by ``every`` with a finite vector of the table's dimension (the most
frequent, the least if tied) is a query and gets min(k, others) neighbours by (distance, neighbour_id) with ranks from 1,
so that of equal distances at the last place the least ids count; null, empty, not finite
or differently long vectors and null ids have no rows and are no one's neighbours; of rows that repeat a vec_id the one
with the least vector counts; equal vectors under different ids are neighbours at distance 0; an empty table has no rows.
Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm.shared import read, written

NEIGHBOURS, EVERY, FIRST, MISS, WIDEN, STEPS = 10, 100, 1000, 0.5, 1.0, 8
PER_CELL, MOST_CENTROIDS, BLOCK, QUERIES, SAMPLE_ROWS = 200, 2048, 16384, 2048, 50_000


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def codebooks(vectors: DataFrame, dim: int, size: int, steps: int = STEPS, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of either half: ``steps`` of Lloyd over the ``sample_rows`` vectors of least hash, from the first ``size`` of them."""
    table = vectors.select("vec", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(max(size, sample_rows)).select("vec").toArrow()
    x = _matrix(table["vec"].combine_chunks(), dim)
    return lloyd(x[:, : dim // 2], size, steps), lloyd(x[:, dim // 2 :], size, steps)


def lloyd(x: np.ndarray, size: int, steps: int) -> np.ndarray:
    book = x[:size].copy()
    for _ in range(steps):
        near = np.concatenate([_squared(x[a : a + 4096], book).argmin(1) for a in range(0, len(x), 4096)])
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        book[own] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.r_[first, len(x)])[:, None] if len(x) else book
    return book


def _assign(books: tuple[np.ndarray, np.ndarray], dim: int):
    half = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            a, b = _squared(x[:, :half], books[0]), _squared(x[:, half:], books[1])
            i, j = a.argmin(1), b.argmin(1)
            rest = a.min(1) + b.min(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(rest, pa.float64())], ["vec_id", "vec", "i", "j", "rest"])

    return run


def traverse(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(a[i] + b[j], i, j) of all centroid pairs in increasing order: the multi-sequence algorithm, with a heap."""
    order_a, order_b = a.argsort(kind="stable").tolist(), b.argsort(kind="stable").tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(a[order_a[0]] + b[order_b[0]], 0, 0)]
    while heap:
        d, p, q = heapq.heappop(heap)
        yield d, order_a[p], order_b[q]
        if q + 1 < len(order_b):
            heapq.heappush(heap, (a[order_a[p]] + b[order_b[q + 1]], p, q + 1))
        if q == 0 and p + 1 < len(order_a):
            heapq.heappush(heap, (a[order_a[p + 1]] + b[order_b[0]], p + 1, 0))


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function at -z, to about a tenth of its value."""
    tail = np.exp(-0.717 * np.abs(z) - 0.416 * z * z) / 2
    return np.where(z >= 0, tail, 1 - tail)


def _visits(books: tuple[np.ndarray, np.ndarray], count: np.ndarray, rest: np.ndarray, dim: int, k: int, first: int, miss: float, widen: float, again: bool):
    """Rows (query, centroid of the first half, centroids of the second) to visit; ``again``: those after the first turn."""
    half = books[0].shape[1]
    most = miss * k
    little = most / (4 * count.size)

    def cells(a: np.ndarray, b: np.ndarray, tau: float) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        seen, left = 0, 0.0
        if again:
            d = a[:, None] + b[None, :]
            nearer = count * (_below((d + rest - tau) / (np.sqrt(4 * widen / dim * d * rest) + 1e-12)) if np.isfinite(tau) else 1.0)
            left = float(nearer.sum())
        for _, i, j in traverse(a, b):
            early = seen < first
            if not early and (not again or left <= most):
                break
            own = int(count[i, j])
            seen += own
            if again:
                left -= nearer[i, j]
            if own and (not again if early else nearer[i, j] > little):
                out.setdefault(i, []).append(j)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), dim)
            a, b = _squared(x[:, :half], books[0]), _squared(x[:, half:], books[1])
            tau = batch.column(4).to_numpy(zero_copy_only=False) if again else np.zeros(len(x))
            at, to, js = [], [], []
            for r in range(len(x)):
                for i, own in cells(a[r], b[r], float(tau[r])).items():
                    at.append(r)
                    to.append(i)
                    js.append(own)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in range(4)), pa.array(to, pa.int32()), pa.array(js, pa.list_(pa.int32()))], ["vec_id", "vec", "qi", "qs", "i", "js"])

    return run


def nearest(qid: np.ndarray, q: np.ndarray, yid: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, neighbour's id, squared distance): at least the k best of ``y`` by (distance, id) for each query, itself left out."""
    own = qid[:, None] == yid[None, :]
    d = np.where(own, np.inf, _squared(q, y))
    bound = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(q), np.inf)
    scale = 1e-9 * (1 + (q * q).sum(1) + (y * y).sum(1).max(initial=0))
    row, col = np.nonzero((d <= (bound + scale)[:, None]) & ~own)
    exact = ((q[row] - y[col]) ** 2).sum(1)
    order = np.lexsort((yid[col], exact, row))
    row, col, exact = row[order], col[order], exact[order]
    start = np.searchsorted(row, np.arange(len(q)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], yid[col[keep]], exact[keep]


def _search(dim: int, k: int):
    def run(queries: pa.Table, entries: pa.Table) -> pa.Table:
        none = pa.table({"vec_id": pa.array([], pa.int64()), "d": pa.array([], pa.float64()), "id": pa.array([], pa.int64())})
        if not len(queries) or not len(entries):
            return none
        q, y = (_matrix(t["vec"].combine_chunks(), dim) for t in (queries, entries))
        qid, yid, j = queries["vec_id"].to_numpy(), entries["vec_id"].to_numpy(), entries["j"].to_numpy()
        js = queries["js"].combine_chunks()
        who, which = np.repeat(np.arange(len(q)), js.value_lengths().to_numpy()), js.flatten().to_numpy()
        parts = []
        for c in np.unique(which):
            asks, has = who[which == c], np.flatnonzero(j == c)
            for s in range(0, len(asks) if len(has) else 0, 1024):
                some = asks[s : s + 1024]
                row, other, d = nearest(qid[some], q[some], yid[has], y[has], k)
                parts.append((some[row], other, d))
        if not parts:
            return none
        row, other, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((other, d, row))
        row, other, d = row[order], other[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.table({"vec_id": pa.array(qid[row[keep]], pa.int64()), "d": pa.array(d[keep], pa.float64()), "id": pa.array(other[keep], pa.int64())})

    return run


def neighbours(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, first: int = FIRST, miss: float = MISS, widen: float = WIDEN, block: int = BLOCK, per_cell: int = PER_CELL) -> DataFrame:
    """(vec_id, neighbour_id, rank, distance): the k approximate nearest neighbours, among all vectors, of those whose id is divisible by ``every``, by Euclidean distance."""
    spark = vectors.sparkSession
    out = "vec_id long, neighbour_id long, rank int, distance double"
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = F.expr("size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) > 1e150)")
    sized = raw.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & sound)
    common = sized.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], out)
    dim = common["dim"]
    clean = written(sized.filter(F.size("vec") == dim).groupBy("vec_id").agg(F.min("vec").alias("vec")))
    size = max(1, min(MOST_CENTROIDS, round((clean.count() / per_cell) ** 0.5)))
    books = codebooks(clean, dim, size)
    placed = written(clean.mapInArrow(_assign(books, dim), "vec_id long, vec array<double>, i int, j int, rest double"))
    count, rest = np.zeros((size, size), np.int32), np.zeros((size, size), np.float32)
    cells = placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.avg("rest").alias("rest")).toArrow()  # at most MOST_CENTROIDS^2 rows
    at = cells["i"].to_numpy(), cells["j"].to_numpy()
    count[at], rest[at] = cells["n"].to_numpy(), cells["rest"].to_numpy()
    parts = [max(1, -(-int(n) // block)) for n in count.sum(1)]
    split = F.element_at(F.array(*map(F.lit, parts)), F.col("i") + 1)
    placed = placed.withColumn("s", F.pmod(F.xxhash64("vec_id"), split).cast("int"))
    asking = placed.filter(F.col("vec_id") % every == 0)
    groups = max(1, -(-asking.count() // QUERIES))
    # centroids that are near each other have near places along the axis of their greatest spread
    spread = books[0] - books[0].mean(0)
    place = np.argsort(np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0])).tolist() if dim > 1 else [0]
    per, beside = max(1, groups // size), min(groups, size)
    near = F.element_at(F.array(*[F.lit(p * beside // size) for p in place]), F.col("i") + 1)
    queries = asking.select("vec_id", "vec", near.alias("qi"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(per)).cast("int").alias("qs"))

    def turn(asked: DataFrame, again: bool) -> DataFrame:
        visits = asked.mapInArrow(_visits(books, count, rest, dim, k, first, miss, widen, again), "vec_id long, vec array<double>, qi int, qs int, i int, js array<int>")
        visits = written(visits.withColumn("s", F.explode(F.sequence(F.lit(0), split - 1))))
        pairs = visits.select(*(F.col(c).alias(c) for c in ("qi", "qs", "i", "s"))).distinct()
        entries = placed.select("vec_id", "vec", "i", "j", "s").join(pairs, ["i", "s"])
        entries = entries.select(*(F.col(c).alias(c) for c in entries.columns))
        keys = ["qi", "qs", "i", "s"]
        return visits.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(_search(dim, k), "vec_id long, d double, id long")

    def best(found: DataFrame) -> DataFrame:
        return found.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k).alias("best"))

    one = written(best(turn(queries, False)))
    tau = one.select("vec_id", F.when(F.size("best") == k, F.expr(f"best[{k - 1}].d")).otherwise(float("inf")).alias("tau"))
    more = turn(queries.join(tau, "vec_id", "left").select("vec_id", "vec", "qi", "qs", F.coalesce("tau", F.lit(float("inf"))).alias("tau")), True)
    both = best(one.select("vec_id", F.explode("best").alias("b")).select("vec_id", "b.d", "b.id").union(more))
    return both.select("vec_id", F.posexplode("best").alias("at", "b")).select("vec_id", F.col("b.id").alias("neighbour_id"), (F.col("at") + 1).alias("rank"), F.sqrt("b.d").alias("distance"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(read(spark, sf_dir, "embeddings"))
