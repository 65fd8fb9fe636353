"""Lookups, hashes and crosses; index 0 is out of vocabulary, NULL included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_VOCABULARY = 1000  # entries up to which a vocabulary is a literal map
BROADCAST_ROWS = 1_000_000


def lookup(x: Column, vocabulary: Sequence) -> Column:
    """1 + the place in the vocabulary; an empty vocabulary knows no value."""
    if len(vocabulary) > LITERAL_VOCABULARY:
        raise ValueError("a vocabulary of this size is joined: lookup_join")
    if not vocabulary:
        return F.lit(0)
    pairs = [y for i, v in enumerate(vocabulary) for y in (F.lit(v), F.lit(i + 1))]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.coalesce(x, F.lit(vocabulary[0]))), F.lit(0)) * F.when(x.isNull(), 0).otherwise(1)


def lookup_join(df: DataFrame, column: str, vocabulary: DataFrame, out: str, size: int) -> DataFrame:
    """``out``: the index by a join with ``vocabulary`` (value, index) of ``size`` rows, broadcast only up to BROADCAST_ROWS."""
    side = vocabulary.select(F.col("value").alias("__value"), F.col("index").alias("__index"))
    side = F.broadcast(side) if size <= BROADCAST_ROWS else side.hint("merge")
    joined = df.join(side, F.col(f"`{column}`") == F.col("__value"), "left")
    return joined.withColumn(out, F.coalesce("__index", F.lit(0))).drop("__value", "__index")


def hash_bucket(x: Column, bins: int, salt: str = "") -> Column:
    """A bucket that is the same in every session and engine: the first 32 bits of an MD5 sum."""
    digest = F.md5(F.concat(F.lit(salt), F.coalesce(x.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % bins).cast("int")


def cross(columns: Sequence[Column], bins: int) -> Column:
    """The hash bucket of the values together, any number of them."""
    return hash_bucket(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), bins)


def embedding_size(vocabulary: int) -> int:
    return min(500, round(1.6 * (vocabulary + 1) ** 0.56))


def embed(index: Column, table: Sequence[Sequence[float]]) -> Column:
    """The row of a weight table, which is a literal: for tables beyond some thousand values join them."""
    return F.element_at(F.lit([[float(v) for v in r] for r in table]).cast("array<array<double>>"), index + 1)


def hash_bins(vocabulary: int) -> int:
    """Buckets for a vocabulary of this size, as the advisor sizes them."""
    if vocabulary < 5000:
        return max(vocabulary * 3 // 10 * 10, 100)
    if vocabulary < 50000:
        return max(vocabulary // 5 // 50 * 50, 1000)
    return max(vocabulary // 10 // 100 * 100, 5000)
