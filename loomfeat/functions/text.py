"""Text cleaning and vectorising with built-in expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LITERAL_VOCABULARY = 1000  # tokens up to which a vocabulary is a literal map; beyond, Arrow looks them up

PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"


def clean(x: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower case, punctuation and stop words to spaces, runs of white space to one space; not trimmed."""
    y = F.regexp_replace(F.lower(x), PUNCTUATION, " ")
    if stop_words:
        y = F.regexp_replace(y, r"\b(" + "|".join(re.escape(w) for w in stop_words) + r")\b\s?", " ")
    return F.regexp_replace(y, r"\s+", " ")


def tokens(x: Column, stop_words: Sequence[str] = ()) -> Column:
    """The tokens of the cleaned text; without stop words by one pattern, with no lambda over the pieces."""
    pieces = F.split(clean(x, stop_words), " ") if stop_words else F.split(F.lower(x), PUNCTUATION[:-1] + r"\s]+")
    return F.array_remove(pieces, "")


def _ids(own: Column, vocabulary: Sequence[str]) -> Column:
    """2 + the place of each token, 1 for others."""
    if len(vocabulary) <= LITERAL_VOCABULARY:
        table = F.create_map(*[y for i, v in enumerate(vocabulary) for y in (F.lit(v), F.lit(i + 2))]) if vocabulary else F.create_map(F.lit(""), F.lit(1))
        return F.transform(own, lambda t: F.coalesce(F.element_at(table, t), F.lit(1)))
    known = pa.array(list(vocabulary), pa.string())

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        at = pc.add(pc.fill_null(pc.index_in(column.flatten(), value_set=known), -1), 2)
        off = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.cast(pc.fill_null(column.value_lengths(), 0), pa.int64()))]).cast(pa.int32())
        return pa.ListArray.from_arrays(off, at.cast(pa.int32()), mask=column.is_null())

    return run(own)


def vectorize(x: Column, vocabulary: Sequence[str], length: int = 35, stop_words: Sequence[str] = (), own: Column | None = None) -> Column:
    """Token indices, padded with 0 and cut at ``length``; 1 is out of vocabulary, the vocabulary begins at 2.

    Here and below ``own`` is a column that holds the tokens already, so that several results cut the text once.
    """
    ids = _ids(F.slice(tokens(x, stop_words) if own is None else own, 1, length), vocabulary)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)


def multi_hot(x: Column, vocabulary: Sequence[str], own: Column | None = None) -> Column:
    own = tokens(x) if own is None else own
    return F.array(*[F.when(F.array_contains(own, v), 1.0).otherwise(0.0) for v in vocabulary])


def ngrams(x: Column, n: int, own: Column | None = None) -> Column:
    """Runs of ``n`` tokens.  The shifted arrays are joined pairwise: a lambda over positions would cut the whole text again for each of them."""
    own = tokens(x) if own is None else own
    many = F.greatest(F.size(own) - (n - 1), F.lit(0))
    out = F.slice(own, F.lit(1), many)
    for i in range(1, n):
        out = F.zip_with(out, F.slice(own, F.lit(i + 1), many), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(own) >= n, out).otherwise(F.array().cast("array<string>"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(token, n) over all rows: one shuffle with map-side counts."""
    return df.select(F.explode(tokens(F.col(column))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def top_tokens(df: DataFrame, column: str, most: int, stop_words: Sequence[str] = ()) -> list[str]:
    """The ``most`` tokens that come most often, of equal counts the least first; at most ``most`` are collected."""
    words = df.select(F.explode(tokens(F.col(f"`{column}`"), stop_words)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return [r["token"] for r in words.orderBy(F.desc("n"), "token").limit(most).collect()]


def record(df: DataFrame, column: str) -> DataFrame:
    """One row: tokens and distinct tokens of a column, the size of the vocabulary to use, the mean and the advised length."""
    own = tokens(F.col(f"`{column}`"))
    each = df.select(F.size(own).alias("n")).agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("tokens"), F.avg(F.when(F.col("n") >= 0, F.col("n"))).alias("mean_length"))
    size = vocabulary(df, column).agg(F.count("*").alias("size"))
    return each.crossJoin(size).select("tokens", "size", F.least("size", F.lit(10000).cast("long")).alias("vocab_size"), "mean_length", F.lit(100).alias("sequence_length"))


def counts(own: Column) -> Column:
    """The distinct tokens of each array with their numbers, as an array of (token, tf)."""

    @F.arrow_udf("array<struct<token: string, tf: bigint>>")
    def run(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)
        coded = column.flatten().dictionary_encode()
        width = max(len(coded.dictionary), 1)
        place, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        off = np.searchsorted(place, np.arange(len(sizes) + 1) * width)
        each = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(place % width)), pa.array(tf, pa.int64())], ["token", "tf"])
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), each)

    return run(own)


def tf_idf(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, token, tf, df, tf_idf) with idf = ln((1 + N) / (1 + df)) + 1.

    Tokens are counted within each row, so that one shuffle by token carries a row for each token of a document; there
    the counts of equal keys meet, and documents are counted, for which no other exchange and no join is needed.
    """
    each = df.select(F.col(key), F.explode(counts(tokens(F.col(column)))).alias("c")).select(key, "c.token", "c.tf").repartition("token")
    tf = each.groupBy(key, "token").agg(F.sum("tf").alias("tf")).withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")))
    rows = df.select(F.count("*").alias("__n"))
    return tf.crossJoin(F.broadcast(rows)).select(key, "token", "tf", "df", (F.col("tf") * (F.ln((1 + F.col("__n")) / (1 + F.col("df"))) + 1)).alias("tf_idf"))
