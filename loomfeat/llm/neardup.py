"""Near duplicates by SuperMinHash signatures, banding, exact verification and union-find.

The signature (Ertl 2017, arXiv:1706.05698) gives each element one permutation of the components with
increasing ranks, so that the components of one signature are negatively correlated and the estimate
of the Jaccard index has less variance than with independent hashes.  An element stops at the first
rank that cannot lower any component.  Here a whole batch advances rank by rank: a document leaves as
soon as all its components are filled, which is that stopping rule for all its elements at once.

Documents with equal shingle sets are linked to the least of them and represented by it.  Representatives that share a
band are a bucket, in which every pair with a Jaccard index of at least the threshold is linked, or its two documents by
a chain of such pairs.  A bucket of up to BLOCK documents is one task's matrix product.  A larger one loses tight clusters
first: all its documents are compared with a pivot; those nearer than half the distance allowed are linked among
themselves by the triangle inequality, and to others only if these lie in a ring around the pivot, which is compared with
them.  What is left is looked up by prefixes: of two sets within the threshold the rarest
|x| - ceil(threshold |x|) + 1 shingles have one in common, so that unlike documents hardly meet; lists of a shingle
that are still long are compared block by block.  No group is collected, no candidate is dropped.

Defined results: null and empty texts (no word) never have partners and are groups of their own; a text
of fewer words than a shingle has one shingle; documents with equal shingle sets are grouped whatever
their number; rows that repeat a doc_id are one document; rows with a null doc_id are one with a null group;
an empty table has no rows.  Extra columns, whatever their names, are ignored by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read, within, written

SHINGLE, BANDS, ROWS, THRESHOLD = 3, 40, 4, 0.5
BLOCK, TURNS = 512, 3  # documents that one task compares with each other; pivots of a larger bucket
FEW = 1_000_000  # rows of ids that are broadcast at most, and compared with a count first
_U = np.uint64
_LAZY = 6
_EMPTY = np.iinfo(np.uint64).max


def superminhash(row: np.ndarray, element: np.ndarray, rows: int, m: int, seed: int = 1) -> np.ndarray:
    """Signatures (rows, m) of the sets {element[row == r]}: rank in the upper half, a uniform value below.

    ``row`` is sorted; a row without elements has the largest value everywhere.
    """
    sig = np.full((rows, m), _EMPTY, _U)
    flat = sig.reshape(-1)
    state = T.mix(element ^ _U(T.mix_int(seed)))
    picks: list[np.ndarray] = []  # k of each earlier rank
    moved: list[np.ndarray] = []  # what the place of that rank held before its swap
    perm = None
    for j in range(m):
        if not len(row):
            break
        x = T.mix(state + _U(j * T.MULT & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((x & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.int64)).astype(np.int16)
        if j < _LAZY:
            at_k, at_j = k.copy(), np.full(len(k), j, np.int16)
            for p, s in zip(picks, moved, strict=True):
                np.copyto(at_k, s, where=p == k)
                np.copyto(at_j, s, where=p == j)
            picks.append(k)
            moved.append(at_j)
        else:
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.int16), (len(row), 1))
                for i, (p, s) in enumerate(zip(picks, moved, strict=True)):
                    perm[np.arange(len(row)), p] = s
                picks, moved = [], []
            here = np.arange(len(row))
            at_k = perm[here, k]
            perm[here, k] = perm[here, j]
        value = (_U(j) << _U(32)) | (x >> _U(32))
        np.minimum.at(flat, row * m + at_k, value)
        present = np.unique(row) if j else row[np.r_[True, row[1:] != row[:-1]]]
        full = (sig[present] != _EMPTY).all(axis=1)
        if full.any():
            done = np.zeros(rows, bool)
            done[present[full]] = True
            go = ~done[row]
            row, state = row[go], state[go]
            picks, moved = [p[go] for p in picks], [s[go] for s in moved]
            perm = perm[go] if perm is not None else None
    return sig


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    parts = sig.reshape(n, m // rows, rows)
    h = np.broadcast_to(np.arange(m // rows, dtype=_U) + _U(1), (n, m // rows)).copy()
    for r in range(rows):
        h = T.mix(h * _U(T.MULT) + parts[:, :, r])
    return h


def _sign(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column(1))
            for a, b in T.slices(off, 1 << 20):
                row, h = T.shingles(T.Words(data[off[a] : off[b]], off[a : b + 1] - off[a]), shingle)
                first = np.searchsorted(row, np.arange(b - a + 1))
                some = first[1:] > first[:-1]
                total = np.r_[_U(0), np.cumsum(h, dtype=_U)]
                print_ = T.mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(_U))
                band = band_hashes(superminhash(row, h, b - a, bands * rows), rows)[some]
                n = int(some.sum())
                lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(band.reshape(-1).view(np.int64)))
                ids = batch.column(0).slice(a, b - a).filter(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(print_[some].view(np.int64)), lists], ["doc_id", "fingerprint", "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.utf8(batch.column(1))
            for a, b in T.slices(off, 1 << 20):
                row, h = T.shingles(T.Words(data[off[a] : off[b]], off[a : b + 1] - off[a]), shingle)
                first = np.searchsorted(row, np.arange(b - a + 1))
                sets = [np.sort((h[first[i] : first[i + 1]] >> _U(32)).astype(np.uint32)).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return run


_DENSE, _COLUMNS = 8, 8192


def alike(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """The symmetric matrix of which sets have a Jaccard index of at least ``threshold``; the sizes of intersections are exact.

    Elements of many sets are columns of matrix products, those of few sets are counted pair by pair.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.float64)
    both = np.zeros((n, n), np.float32)
    flat, who = np.concatenate(sets), np.repeat(np.arange(n), size.astype(np.int64))
    order = np.argsort(flat, kind="stable")
    flat, who = flat[order], who[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(flat)])
    column = np.repeat(np.where(count > _DENSE, np.cumsum(count > _DENSE) - 1, -1), count)
    for c in range(0, int((count > _DENSE).sum()), _COLUMNS):
        x = np.zeros((n, _COLUMNS), np.float32)
        at = (column >= c) & (column < c + _COLUMNS)
        x[who[at], column[at] - c] = 1
        both += x @ x.T
    few, own = flat[column < 0], who[column < 0]
    for d in range(1, _DENSE):
        same = few[d:] == few[:-d]
        if not same.any():
            break
        pair = np.bincount(own[:-d][same] * n + own[d:][same], minlength=n * n).reshape(n, n)
        both += pair + pair.T
    return both >= threshold * np.maximum(size[:, None] + size[None, :] - both, 1e-9)


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in table["shingles"].to_pylist()]


def _compare(threshold: float):
    """Links of a bucket, or between its two sides if it has two; of each connected part only a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, side = table["doc_id"].to_numpy(), table["side"].to_numpy()
        near = np.triu(alike(_sets_of(table), threshold), 1)
        if side.any() and not side.all():
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(near)
        keep = forest(a, b)
        return pa.table({"a": ids[a[keep]], "b": ids[b[keep]]})

    return run


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which edges join two parts that those before them left apart."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[y] = x
            keep.append(i)
    return keep


def _to_pivot(table: pa.Table) -> pa.Table:
    """(pivot, doc_id, jaccard) of a part of the documents that have one pivot, for each set of the pivot: the rows with the side 1."""
    side = table["side"].to_numpy() == 1
    sets = _sets_of(table)
    centre = [sets[i] for i in np.flatnonzero(side)]
    table, sets = table.filter(pa.array(~side)), [sets[i] for i in np.flatnonzero(~side)]
    size = np.array([len(x) for x in sets], np.int64)
    at, out = np.r_[0, np.cumsum(size)], []
    for pivot in centre:
        both = np.diff(np.r_[0, np.cumsum(np.isin(np.concatenate(sets), pivot))][at]) if sets else np.zeros(0)
        out.append(pa.table({"pivot": table["pivot"], "doc_id": table["doc_id"], "jaccard": pa.array(both / (size + len(pivot) - both), pa.float64())}))
    return pa.concat_tables(out)


def _by_count(df: DataFrame, keys: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that broadcasts ``keys`` if a count has shown that they are few; beyond, adaptive execution splits hot keys."""
    return df.join(F.broadcast(keys) if keys.count() <= FEW else keys.hint("merge"), on, how)


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """(bucket, doc_id, n) of the buckets of several documents, one of each that hold the same; ``rows`` (bucket, doc_id) are distinct.

    Documents are compared by two 64-bit sums of hashes, so that no list of a bucket is made.
    """
    same = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(2))).alias("y"))
    one = written(same.filter("n > 1").groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    return _by_count(rows, one, ["bucket"], "inner")


_NO_EDGES = "a long, b long"


def _with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    rows = written(rows)
    return sets.join(F.broadcast(rows) if rows.count() <= FEW else rows.hint("merge"), "doc_id")


def _in_cells(rows: DataFrame, sets: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Links of the cells that ``rows`` (keys, doc_id, side) make, each of about 2 BLOCK documents at most.

    Few rows are sent to the sets, which then move once, to their cells.
    """
    return _with_sets(rows, sets).groupBy(*keys).applyInArrow(_compare(threshold), _NO_EDGES)


def _by_blocks(lists: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links of lists (bucket, doc_id, n) of any length: each pair of blocks of documents is a cell."""
    many = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("doc_id", F.lit(3)), many).cast("int")
    cells = lists.select("bucket", "doc_id", own.alias("o"), F.explode(F.sequence(F.lit(0), many - 1)).alias("x"))
    cells = cells.select("bucket", F.least("o", "x").alias("i"), F.greatest("o", "x").alias("j"), "doc_id", (F.col("o") > F.col("x")).cast("int").alias("side"))
    return _in_cells(cells, sets, ["bucket", "i", "j"], threshold)


def _across(core: DataFrame, ring: DataFrame, sets: DataFrame, threshold: float, block: int) -> DataFrame:
    """Links between the core and the ring (bucket, doc_id) of each bucket, block by block."""
    size = lambda df, n: df.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    both = size(core, "c").join(size(ring, "r"), "bucket")
    place = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(3)), n).cast("int")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = _by_count(core, both, ["bucket"], "inner").select("bucket", place(F.col("c")).alias("i"), up_to("r").alias("j"), "doc_id", F.lit(0).alias("side"))
    two = _by_count(ring, both, ["bucket"], "inner").select("bucket", up_to("c").alias("i"), place(F.col("r")).alias("j"), "doc_id", F.lit(1).alias("side"))
    return _in_cells(one.union(two), sets, ["bucket", "i", "j"], threshold)


def _split(large: DataFrame, sets: DataFrame, threshold: float, block: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(links, rest): what a pivot of each large bucket (bucket, doc_id) settles, and the documents that are left."""
    pivots = written(large.groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(turn))).alias("pivot")))
    pairs = written(_by_count(large, pivots, ["bucket"], "inner").select("bucket", "pivot", "doc_id"))
    distinct = pairs.filter("doc_id <> pivot").select("pivot", "doc_id").distinct()
    parts = written(distinct.groupBy("pivot").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("parts")))
    each = _by_count(distinct, parts, ["pivot"], "inner").select("pivot", F.pmod(F.xxhash64("doc_id", F.lit(5)), "parts").cast("int").alias("part"), "doc_id", F.lit(0).alias("side"))
    centre = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("doc_id"), F.lit(1).alias("side"))
    # a part with no document in it has a pivot only
    found = written(_with_sets(each.union(centre), sets).groupBy("pivot", "part").applyInArrow(_to_pivot, "pivot long, doc_id long, jaccard double"))
    known = written(pairs.filter("doc_id <> pivot").join(found, ["pivot", "doc_id"]).select("bucket", "doc_id", "jaccard"))
    half = (1 - threshold) / 2
    core = known.filter(F.col("jaccard") >= 1 - half).select("bucket", "doc_id")
    ring = known.filter((F.col("jaccard") < threshold) & (F.col("jaccard") >= threshold - half)).select("bucket", "doc_id")
    links = found.filter(F.col("jaccard") >= threshold).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b"))
    if not ring.isEmpty():
        links = links.union(_across(core, ring, sets, threshold, block))
    return links, written(known.filter(F.col("jaccard") < 1 - half).select("bucket", "doc_id"))


def _elements(shingles: Column) -> Column:
    @F.arrow_udf("array<long>")
    def run(column: pa.Array) -> pa.Array:
        sets = [np.frombuffer(x, np.uint32) for x in column.to_pylist()]
        off = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*sets, np.zeros(0, np.uint32)]).astype(np.int64)))

    return run(shingles)


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """(bucket, doc_id): the rarest elements of each set, enough that any two sets within the threshold share one."""
    each = written(sets.select("doc_id", F.explode(_elements(F.col("shingles"))).alias("bucket")))
    often = each.groupBy("bucket").agg(F.count("*").alias("n"))
    ranked = each.join(often, "bucket").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "bucket"))).alias("e"))  # the elements of one document
    size = F.size("e")
    some = F.slice("e", F.lit(1), (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int"))
    return ranked.select("doc_id", F.explode(F.filter(some, lambda x: x["n"] > 1)).alias("x")).select("x.bucket", "doc_id")


def links_of(buckets: DataFrame, sets: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, turns: int = TURNS) -> DataFrame:
    """(a, b): links that connect what the comparison of all pairs of each bucket (bucket, doc_id, n) connects."""
    small = buckets.filter(F.col("n") <= block).select("bucket", "doc_id", F.lit(0).alias("side"))
    out = _in_cells(small, sets, ["bucket"], threshold)
    large = buckets.filter(F.col("n") > block).select("bucket", "doc_id")
    if large.isEmpty():
        return out
    large = written(large)
    for turn in range(turns):
        found, large = _split(large, sets, threshold, block, turn)
        out = out.union(found)
        if large.isEmpty():
            return out
    rest = written(within(sets, large.select("doc_id").distinct(), "doc_id", FEW))
    lists = written(_distinct_buckets(written(_prefixes(rest, threshold))))
    short = lists.filter(F.col("n") <= block).select("bucket", "doc_id", F.lit(0).alias("side"))
    return out.union(_in_cells(short, rest, ["bucket"], threshold)).union(_by_blocks(lists.filter(F.col("n") > block), rest, threshold, block))


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[find(x) for x in range(len(nodes))]] if len(nodes) else nodes


def components(edges: DataFrame, driver_edges: int = 4_000_000) -> DataFrame:
    """(doc_id, group_id) of the nodes of ``edges`` (a, b); group_id is the least doc_id of the component.

    Up to ``driver_edges`` edges, counted first, a union-find runs on the driver (64 MB of ids at most).  Beyond, the
    edges are contracted where they lie: alternating large-star and small-star steps (Kiveris et al. 2014), each
    written to the shared folder, until no edge changes.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b")
    if edges.count() <= driver_edges:
        table = edges.toArrow()
        node, group = union_find(table["a"].to_numpy(), table["b"].to_numpy())
        return spark.createDataFrame(pa.table({"doc_id": pa.array(node, pa.int64()), "group_id": pa.array(group, pa.int64())}))
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        edges = written(small.filter("a <> b").distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    leaves = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("group_id"))
    return leaves.union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(doc_id, group_id, group_size, links, kept) for each distinct doc_id; ``kept`` marks one document of each group.

    ``links`` are the verified links of a document: to the least of its copies, and those between different texts that span
    the group.  With 40 bands of 4 rows a pair at the threshold of 0.5 is a candidate with probability 0.92, at 0.6 with 0.996.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.filter("doc_id is not null").mapInArrow(_sign(shingle, bands, rows), "doc_id long, fingerprint long, bands array<long>"))
    first = signed.groupBy("fingerprint").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a <> z").select("fingerprint", "a")
    copies = written(_by_count(signed.select("fingerprint", "doc_id"), written(first), ["fingerprint"], "inner").filter("doc_id <> a").distinct())
    kept = _by_count(signed, copies.select("fingerprint", "doc_id"), ["fingerprint", "doc_id"], "left_anti").select("doc_id", F.explode("bands").alias("bucket"))
    shared = written(kept.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a <> z").select("bucket"))
    buckets = written(_distinct_buckets(written(_by_count(kept, shared, ["bucket"], "left_semi").select("bucket", "doc_id").distinct())))
    # a document that comes several times with different texts has the sets of all of them, each compared for itself
    texts = within(docs, buckets.select("doc_id").distinct(), "doc_id")
    sets = written(texts.mapInArrow(_sets(shingle), "doc_id long, shingles binary"))
    links = links_of(buckets, sets, threshold, block).filter("a <> b")
    edges = written(copies.select("a", F.col("doc_id").alias("b")).union(links).distinct())
    groups = components(edges)
    size = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    many = edges.select("a").union(edges.select("b")).groupBy(F.col("a").alias("doc_id")).agg(F.count("*").alias("links"))
    whole = docs.select("doc_id").distinct().join(groups.join(size, "group_id").join(many, "doc_id"), "doc_id", "left")
    group = F.coalesce("group_id", "doc_id")
    return whole.select("doc_id", group.alias("group_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce(F.col("doc_id") == group, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, **params: object) -> DataFrame:
    """The documents with one of each group of near duplicates: the row with the least doc_id.

    Rows that repeat a doc_id are reduced to the one with the least (text, other columns); rows with a null doc_id, null or
    empty text stay unless they repeat a doc_id; an empty table stays empty; all columns are kept as they are.
    """
    groups = written(near_duplicates(docs, **params))
    gone = groups.filter("not kept").select("doc_id")
    stay = _by_count(docs, gone, ["doc_id"], "left_anti")
    twice = written(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    if twice.isEmpty():
        return stay
    again = within(stay, twice, "doc_id")
    columns = [F.col(f"`{c}`") for c in again.columns]
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*columns), F.struct("text", F.xxhash64(*columns))).alias("r")).select("r.*")
    return stay.join(twice, "doc_id", "left_anti").unionByName(first)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
