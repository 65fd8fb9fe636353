"""Document quality by Bradley-Terry pairwise ranking.

A preference pair is a document labelled good and one labelled bad; the probability that the first is
preferred is the logistic function of the difference of their scores, which are linear in the features.
Training minimises the logistic loss of the feature differences of such pairs, drawn from a sample of at most SAMPLE_ROWS
documents a class.  Scores don't depend on how rows are batched, so that a text may be scored twice.  A document stays
if its score is at least the quantile GOOD_QUANTILE of the scores of all documents labelled good: this bounds the share
of good documents that are lost whatever the share of bad ones in the corpus, where a quantile of all scores would
reject as many of a clean corpus.

Defined results: null and empty texts have no word and get the lowest score (LOWEST, minus infinity is avoided),
so they are rejected; equal feature vectors get equal scores; every row is scored for itself, so repeated rows
and null doc_ids stay apart; a document with several labels counts as bad if one of them says so, null labels say nothing;
without labels of both classes every document with a word is kept with score 0; an empty table has no rows.  Extra columns,
whatever their names, change nothing and are kept by keep_good.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read, written
from loomfeat.operators.stats import ranked

SAMPLE_ROWS = 4000  # most labelled documents of each class that training uses
PAIRS = 40_000
GOOD_QUANTILE = 0.002
LOWEST = -1e6
FEW = 2_000_000  # ids of labelled documents that are broadcast at most
FEATURES = ("log_words", "word_bytes", "symbols", "upper", "exclaim", "bars", "digits", "stops", "short_lines", "repeated_lines", "new_words", "words_a_line")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~<>{}[]\\=+_`")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:?")] = True


def _per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    key = np.unique((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=rows)[:rows].astype(float)


def features(column: pa.Array) -> np.ndarray:
    """(rows, len(FEATURES)) of whole texts; rows without a word are all zero."""
    data, off = T.utf8(column)
    return np.concatenate([_slice(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in T.slices(off, 1 << 20)] or [np.zeros((0, len(FEATURES)))])


def _slice(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    w = T.Words(data, off)
    words = np.diff(w.first).astype(float)
    size = np.maximum(1, np.diff(off)).astype(float)
    n = np.maximum(1, words)
    # a line ends at a line feed or with its text; the texts of a slice follow each other
    stops = np.union1d(np.flatnonzero(data == 10) + 1, off[1:])
    stops = stops[stops > 0]
    starts = np.r_[0, stops[:-1]] if len(stops) else stops
    line_row = np.searchsorted(off, starts, "right") - 1
    lines = np.maximum(1, np.bincount(line_row, minlength=rows)[:rows]).astype(float)
    short = np.bincount(line_row[(stops - starts) < 24], minlength=rows)[:rows]
    new_lines = _distinct(line_row, T.span_hash(data, starts, stops), rows)
    byte_sum = np.r_[0, np.cumsum(w.end - w.start)]
    frac = lambda flags: _per_row(flags, off) / size
    out = np.column_stack([
        np.log1p(words), (byte_sum[w.first[1:]] - byte_sum[w.first[:-1]]) / n, frac(_SYMBOL[data]), frac(_UPPER[data]), frac(data == 33), frac(data == 124),
        frac(_DIGIT[data]), _per_row(_STOP[data], off) / n, short / lines, 1 - new_lines / lines, _distinct(w.row, w.hash, rows) / n ** 0.9, np.log1p(words / lines),
    ])
    out[:, 2:7] = np.log1p(100 * out[:, 2:7])
    out[words == 0] = 0
    return out


def fit(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS, l2: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, weights): the score is (x - mean) @ weights.  Newton's method on the loss of random pairs, without a bias."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([good, bad])
    mean, scale = both.mean(0), both.std(0)
    scale[scale < 1e-9] = 1
    g, b = rng.integers(0, len(good), pairs), rng.integers(0, len(bad), pairs)
    d = (good[g] - bad[b]) / scale
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # of the wrong order
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w)), d.T @ p / pairs - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, w / scale


def _features_of(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        x = features(column)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))

    return run(text)


def weighted(x: np.ndarray, mean: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(x - mean) @ weights, each row summed in one order: the last bits of a matrix product depend on the batch around a row."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += (x[:, j] - mean[j]) * weights[j]
    return out


def score_of(text: Column, mean: np.ndarray, weights: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        x = features(column)
        return pa.array(np.where(x[:, 0] > 0, weighted(x, mean, weights), LOWEST))

    return run(text)


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row a labelled document."""
    return labels.filter("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray] | None:
    """(mean, weights) from the labelled documents of least hash, ``sample_rows`` a class at most; None without both classes."""
    quality = known_labels(labels)
    order = [F.xxhash64("doc_id"), "doc_id"]
    present = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null and text <> ''")
    # ids of labelled documents that are there: their ids alone are joined, the texts only of the sample
    there = written(_labelled(present.select("doc_id"), quality).distinct())
    ids = there.filter("quality = 1").orderBy(*order).limit(sample_rows).union(there.filter("quality = 0").orderBy(*order).limit(sample_rows))
    # an id that many rows repeat is one of the sample, with the greatest features; a filter of them here would be pushed
    # below the join, and all documents' features computed for it
    known = present.join(F.broadcast(ids), "doc_id").select("doc_id", "quality", _features_of(F.col("text")).alias("x")).groupBy("doc_id", "quality").agg(F.max("x").alias("x")).toArrow()
    x = np.array(known["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    some = x[:, 0] > 0
    x, good = x[some], known["quality"].to_numpy()[some] == 1
    if not good.any() or good.all():
        return None
    order = np.lexsort(x.T)  # rows come in any order
    return fit(x[order][good[order]], x[order][~good[order]])


def _labelled(rows: DataFrame, quality: DataFrame) -> DataFrame:
    small = quality.count() <= FEW
    return rows.join(F.broadcast(quality) if small else quality.hint("merge"), "doc_id")


def threshold_of(scores: DataFrame, labels: DataFrame, good_quantile: float = GOOD_QUANTILE) -> float:
    """The least score of (doc_id, score) that at least ``good_quantile`` of all documents labelled good do not exceed; exact, by ranks over all of them."""
    good = _labelled(scores.filter(F.col("score") > LOWEST).select("doc_id", "score"), known_labels(labels).filter("quality = 1"))
    ranks = ranked(good, ["score", "doc_id"], "rank")
    return float(ranks.filter(F.col("rank") == max(1, math.ceil(good_quantile * ranks.count()))).first()["score"])


def _scoring(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray, bool]:
    fitted = train(docs, labels, sample_rows)
    return (*fitted, True) if fitted else (np.zeros(len(FEATURES)), np.zeros(len(FEATURES)), False)


def scored(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_quantile: float = GOOD_QUANTILE) -> DataFrame:
    """(doc_id, score, kept) of every row."""
    mean, weights, fitted = _scoring(docs, labels, sample_rows)
    scores = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_of(F.col("text"), mean, weights).alias("score")))
    return scores.withColumn("kept", F.col("score") >= (threshold_of(scores, labels, good_quantile) if fitted else 0.0))


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, good_quantile: float = GOOD_QUANTILE) -> DataFrame:
    """The rows that are kept, with all their columns; null and empty texts go, empty tables stay empty.

    Only ids and scores are written, for the threshold, of the documents labelled good if their ids can be broadcast and of
    all beyond; the rows are then filtered by their scores, computed again.  A table of the texts would take as much disk as they do.
    """
    mean, weights, fitted = _scoring(docs, labels, sample_rows)
    score = score_of(F.col("text"), mean, weights)
    threshold = 0.0
    if fitted:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        good = known_labels(labels).filter("quality = 1").select("doc_id")
        if good.count() <= FEW:
            rows = rows.join(F.broadcast(good), "doc_id", "left_semi")
        threshold = threshold_of(written(rows.select("doc_id", score.alias("score"))), labels, good_quantile)
    return docs.filter(score >= threshold)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
