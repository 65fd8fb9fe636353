"""Toxicity by a factorization machine over hashed terms.

A document is the set of its words, each hashed to one of 2^BITS terms.  Its score is b + sum w_i + sum over pairs <v_i, v_j>
(Rendle 2010), where the sum over pairs is (|sum v|^2 - sum |v|^2) / 2.  The factors learn what additive weights
miss: two terms that are harmless apart and toxic together.  Training fits logistic loss on a bounded sample of labelled
documents, over all terms that tell its classes apart, alone or in pairs: a term that says nothing by itself is chosen if
the documents that hold it with another term have other labels than either term explains.  The threshold is the one that
errs least over all labelled documents outside the training part.

Defined results: null and empty texts have no terms, the score LOWEST and are never toxic; a repeated word counts
once; repeated rows are scored alike, each for itself; null doc_ids are kept; a document with several labels is toxic if one
of them says so; without labels of both classes nothing is toxic; an empty table has no rows.  Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read, written

BITS = 24
SAMPLE_ROWS = 6000  # most labelled documents of each class that training uses
FACTORS, MIN_DOCS, MIN_CHI, MIN_Z = 4, 5, 30.0, 7.0  # what is beyond chance among many terms, and among their pairs
LOWEST = -1e6
EPOCHS, RATE, L2 = 150, 0.05, 5e-3


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the distinct terms of each row, in order."""
    data, off = T.utf8(column)
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in T.slices(off, 1 << 20):
        w = T.Words(data[off[a] : off[b]], off[a : b + 1] - off[a])
        key = np.sort((w.row.astype(np.int64) << BITS) | (w.hash >> np.uint64(64 - BITS)).astype(np.int64))
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        rows.append((key >> BITS) + a)
        found.append(key & ((1 << BITS) - 1))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Machine:
    """terms: the known ones, sorted; w, v: their weights and factors."""

    terms: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray
    _known: np.ndarray | None = field(default=None, repr=False, compare=False)

    def indexed(self, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) of the terms that the machine knows."""
        if self._known is None:
            self._known = np.zeros(1 << BITS, bool)
            self._known[self.terms] = True
        keep = self._known[term]
        return row[keep], np.searchsorted(self.terms, term[keep])

    def scores(self, row: np.ndarray, index: np.ndarray, rows: int) -> np.ndarray:
        linear = np.bincount(row, self.w[index], rows)
        total = np.column_stack([np.bincount(row, self.v[index, f], rows) for f in range(self.v.shape[1])])
        squares = np.bincount(row, (self.v[index] ** 2).sum(1), rows)
        return self.bias + linear + 0.5 * ((total**2).sum(1) - squares)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": None}


def choose(row: np.ndarray, term: np.ndarray, y: np.ndarray, min_docs: int = MIN_DOCS, min_chi: float = MIN_CHI, min_z: float = MIN_Z) -> np.ndarray:
    """All terms whose chi-squared statistic for the class is beyond chance, and those of which a pair is."""
    known, index = np.unique(term, return_inverse=True)
    n, pos = np.bincount(index).astype(float), np.bincount(index, y[row])
    total, toxic = len(y), y.sum()
    expected = n * toxic / total
    chi = (pos - expected) ** 2 / (expected * (1 - toxic / total) * (1 - n / total) + 1e-9)
    best = (n >= min_docs) & (chi >= min_chi)
    # a pair of n documents has a z of sqrt(n) at most
    often = np.flatnonzero(n >= min_z**2)
    best[often[_paired(row, index, y, often, len(known), min_z)]] = True
    return known[best]


def _paired(row: np.ndarray, index: np.ndarray, y: np.ndarray, often: np.ndarray, terms: int, min_z: float, block: int = 1024) -> np.ndarray:
    """Which of the terms ``often`` are in a pair whose documents have other labels than either of the two terms has, by ``min_z`` deviations."""
    place = np.full(terms, -1, np.int64)
    place[often] = np.arange(len(often))
    keep = place[index] >= 0
    row, column = row[keep], place[index[keep]]
    rest = (y - y.mean()).astype(np.float32)
    deviation = max(float(rest.std()), 1e-9)
    mean = np.bincount(column, rest[row], len(often)) / np.maximum(np.bincount(column, minlength=len(often)), 1)

    def part(a: int) -> np.ndarray:
        at = (column >= a) & (column < a + block)
        x = np.zeros((len(y), min(block, len(often) - a)), np.float32)
        x[row[at], column[at] - a] = 1
        return x

    out = np.zeros(len(often), bool)
    for a in range(0, len(often), block):
        x = part(a)
        for b in range(a, len(often), block):
            z = part(b) if b > a else x
            many, labels = x.T @ z, (x * rest[:, None]).T @ z
            off = np.minimum(np.abs(labels - many * mean[a : a + block, None]), np.abs(labels - many * mean[None, b : b + block]))
            hit = off > min_z * deviation * np.sqrt(np.maximum(many, 1))
            if a == b:
                np.fill_diagonal(hit, False)
            out[a : a + block] |= hit.any(1)
            out[b : b + block] |= hit.any(0)
    return out


def fit(row: np.ndarray, term: np.ndarray, y: np.ndarray, chosen: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, l2: float = L2, seed: int = 5) -> Machine:
    """Adam on the class-balanced logistic loss of all rows."""
    rng = np.random.default_rng(seed)
    m = Machine(chosen, 0.0, np.zeros(len(chosen)), rng.normal(0, 0.1, (len(chosen), factors)))
    row, index = m.indexed(row, term)
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    first, second = ([np.zeros(()), np.zeros_like(m.w), np.zeros_like(m.v)] for _ in range(2))
    for step in range(1, epochs + 1):
        total = np.column_stack([np.bincount(row, m.v[index, f], len(y)) for f in range(factors)])
        g = weight * (1 / (1 + np.exp(-np.clip(m.scores(row, index, len(y)), -40, 40))) - y)
        per = g[row]
        grad_v = np.column_stack([np.bincount(index, per * (total[row, f] - m.v[index, f]), len(chosen)) for f in range(factors)])
        grads = [g.sum(), np.bincount(index, per, len(chosen)) + l2 * m.w / len(chosen) ** 0.5, grad_v + l2 * m.v / len(chosen) ** 0.5]
        out = []
        for k, (x, d) in enumerate(zip((m.bias, m.w, m.v), grads, strict=True)):
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d**2
            out.append(x - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        m.bias, m.w, m.v = float(out[0]), out[1], out[2]
    return m


def best_cut(labelled: DataFrame, clean_weight: float) -> float:
    """The middle of the widest gap among the cuts of (score, y) with the least error, where a clean row counts ``clean_weight`` times.

    Exact over all rows: their counts by score lie in ranges of the score, each range is summed for itself and shifted by
    the sums of the ranges before it, which are one row a partition.
    """
    counts = labelled.groupBy("score").agg(F.sum("y").cast("long").alias("t"), F.sum(1 - F.col("y")).cast("long").alias("c"))
    ranged = written(counts.repartitionByRange("score").withColumn("p", F.spark_partition_id()))
    # one row a partition
    parts = ranged.groupBy("p").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.min("score").alias("lo"), F.max("score").alias("hi")).orderBy("lo").collect()
    clean, before, rows = sum(x["c"] for x in parts), (0, 0), []
    for i, x in enumerate(parts):
        rows.append((x["p"], *before, parts[i - 1]["hi"] if i else None))
        before = before[0] + x["t"], before[1] + x["c"]
    shift = F.broadcast(labelled.sparkSession.createDataFrame(rows, "p int, t0 long, c0 long, hi double"))
    w = Window.partitionBy("p").orderBy("score")
    last = F.coalesce(F.lag("score").over(w), F.col("hi"))
    # the cut below each score: toxic rows under it and clean rows from it on are errors
    below = ranged.join(shift, "p").select("score", last.alias("last"), (F.col("t0") + F.sum("t").over(w) - F.col("t")).alias("toxic"), (F.col("c0") + F.sum("c").over(w) - F.col("c")).alias("clean"))
    error = F.col("toxic") + clean_weight * (clean - F.col("clean"))
    cuts = written(below.select("score", "last", error.alias("error")))
    # the cut above every score leaves all toxic rows as errors
    lowest, most = min(float(before[0]), cuts.agg(F.min("error")).first()[0]), parts[-1]["hi"]
    gap = F.coalesce(F.col("score") - F.col("last"), F.lit(1.0))
    best = cuts.filter(F.col("error") <= lowest + 1e-9 * (1 + lowest)).select("score", "last", gap.alias("gap")).orderBy(F.desc("gap"), "score").first()
    if best is None or before[0] <= lowest + 1e-9 * (1 + lowest) and best["gap"] < 1:
        return most + 1
    return best["score"] - 1 if best["last"] is None else (best["score"] + best["last"]) / 2


def _all_terms(text: Column) -> Column:
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        row, term = terms(column)
        off = np.searchsorted(row, np.arange(len(column) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(off, pa.array(term.astype(np.int32)))

    return run(text)


def score_of(text: Column, machine: Machine) -> Column:
    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        row, term = terms(column)
        some = np.zeros(len(column), bool)
        some[row] = True
        return pa.array(np.where(some, machine.scores(*machine.indexed(row, term), len(column)), LOWEST))

    return run(text)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, y), one row a labelled document."""
    return labels.filter("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Machine, np.ndarray] | None:
    """The machine fitted on four fifths of the sample, still without a threshold, and the doc_ids it was fitted on; None without both classes."""
    toxic = known_labels(labels)
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = toxic.filter("y = 1").orderBy(*order).limit(sample_rows).union(toxic.filter("y = 0").orderBy(*order).limit(sample_rows))
    # at most 2 * sample_rows ids, so that a broadcast has a fixed size
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    # an id that many rows repeat is one of the sample, with the least terms
    rows = written(known.select("doc_id", "y", _all_terms(F.col("text")).alias("terms")).groupBy("doc_id", "y").agg(F.min("terms").alias("terms"))).orderBy("doc_id").toArrow()
    y = rows["y"].to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return None
    lists = rows["terms"].combine_chunks()
    term = np.asarray(lists.flatten()).astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    held = T.mix(rows["doc_id"].to_numpy().view(np.uint64)) % np.uint64(5) == 0
    if not (0 < y[held].sum() < held.sum() and 0 < y[~held].sum() < (~held).sum()):
        held[:] = False
    renumber = np.cumsum(~held) - 1
    train_at = ~held[row]
    r, t, target = renumber[row[train_at]], term[train_at], y[~held]
    return fit(r, t, target, choose(r, t, target)), np.unique(rows["doc_id"].to_numpy()[~held])


def threshold_of(scores: DataFrame, labels: DataFrame, used: np.ndarray) -> float:
    """The cut with the least error over every labelled document that the fit did not use; over all of them if those lack a class."""
    spark = scores.sparkSession
    seen = F.broadcast(spark.createDataFrame([(int(i), True) for i in used], "doc_id long, used boolean"))
    known = written(scores.join(known_labels(labels), "doc_id").join(seen, "doc_id", "left").select("score", "y", F.coalesce("used", F.lit(False)).alias("used")))
    n = known.agg(*[F.count_if((F.col("y") == k) & (F.col("used") == u)).alias(f"{k}{u}") for k in (0, 1) for u in (False, True)]).first()
    if not (n["0False"] and n["1False"]):
        return best_cut(known, 1.0)
    # the fit took other shares of the classes than the labels have
    weight = ((n["0False"] + n["0True"]) / n["0False"]) / ((n["1False"] + n["1True"]) / n["1False"])
    return best_cut(known.filter("not used"), weight)


def toxicity(docs: DataFrame, labels: DataFrame, **params: int) -> DataFrame:
    """(doc_id, score, toxic) of every row."""
    fitted = train(docs, labels, **params)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if fitted is None:
        return ids.select("doc_id", F.lit(0.0).alias("score"), F.lit(False).alias("toxic"))
    machine, used = fitted
    # scored once, for the threshold and for the result
    scores = written(ids.select("doc_id", score_of(F.col("text"), machine).alias("score")))
    return scores.withColumn("toxic", (F.col("score") > LOWEST) & (F.col("score") >= threshold_of(scores, labels, used)))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
