"""Token counts of documents from flat, unindexed token files, by a separator scan.

A token file is nothing but token identifiers of fixed width, each document followed by the end-of-document identifier.
Blocks of any file are read independently; within a block one vectorised comparison finds the separators and gives the
lengths of the documents that lie inside.  What crosses a block's edge is stitched by two prefix scans over the blocks of
a file: the running number of separators numbers the documents, and the running maximum of separator positions tells
where the document that a block begins with has started.

Defined results: null and empty texts have 0 tokens and still end with a separator; tokens after a file's last separator are
a document of their own; an empty file has no documents; documents longer than a block, or than many, are counted whole;
rows that repeat a doc_id are counted each for itself; a null doc_id is reported as null; an empty table has no rows.  Extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read, scratch, written

RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
EOD = 50256
BLOCK_TOKENS = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str = PATTERN) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def write_token_files(docs: DataFrame, folder: str, ranks: str = RANKS, eod: int = EOD) -> DataFrame:
    """One flat uint16 file a task in ``folder``; returns (file, ordinal, doc_id), the order of the documents.

    A file's name is new for each attempt of a task, and only those of attempts that succeeded are in the result: a task that
    is run again, or twice at once, does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokenizer(ranks)
        where, base = _open(folder)
        where.create_dir(base, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        ordinal = 0
        with where.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1)
                _, off = T.utf8(texts)
                for a, b in T.slices(off, 1 << 20):
                    for x in texts.slice(a, b - a):
                        x = x.as_py()
                        tokens = encoding.encode_ordinary(x) if x else []
                        tokens.append(eod)
                        out.write(np.array(tokens, "<u2").tobytes())
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), ids], ["file", "ordinal", "doc_id"])
                ordinal += n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, ordinal long, doc_id long")


def _blocks(folder: str, eod: int, dtype: str):
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with where.open_input_file(f"{base}/{row['file']}") as f:
                    tokens = np.frombuffer(f.read_at(row["n"] * width, row["start"] * width), dtype)
                seps = np.flatnonzero(tokens == eod)
                inner = np.diff(seps) - 1
                head, last = (int(seps[0]), int(seps[-1]) + row["start"]) if len(seps) else (len(tokens), None)
                yield pa.RecordBatch.from_pylist([row | {"seps": len(seps), "head": head, "last": last, "inner": inner.tolist()}], _SUMMARY)

    return run


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("seps", pa.int64()), ("head", pa.int64()), ("last", pa.int64()), ("inner", pa.list_(pa.int64()))])


def scan(spark: SparkSession, folder: str, files: DataFrame | None = None, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) of each document of the token files: those in ``files`` (file), or all in ``folder``."""
    where, base = _open(folder)
    width = np.dtype(dtype).itemsize
    there = [(x.base_name, x.size // width) for x in where.get_file_info(fs.FileSelector(base, allow_not_found=True)) if x.is_file and x.size >= width]
    sizes = spark.createDataFrame(there or [("", 0)], "file string, tokens long").filter("tokens > 0")
    if files is not None:
        sizes = sizes.join(files.select("file").distinct(), "file", "left_semi")
    starts = sizes.select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block_tokens).cast("long"))).alias("start"))
    blocks = starts.select("file", "start", F.least(F.col("tokens") - F.col("start"), F.lit(block_tokens)).cast("long").alias("n"))
    summary = blocks.repartition("file", "start").mapInArrow(_blocks(folder, eod, dtype), "file string, start long, n long, seps long, head long, last long, inner array<long>")
    order = Window.partitionBy("file").orderBy("start")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    stitched = summary.select(
        "file", "n", "seps", "head", "inner", "start", "last",
        F.coalesce(F.sum("seps").over(earlier), F.lit(0)).alias("ordinal"),
        (F.col("start") - 1 - F.coalesce(F.max("last").over(earlier), F.lit(-1))).alias("carried"),
        F.lead("start").over(order).isNull().alias("ends"),
    )
    rest = F.when(F.col("seps") > 0, F.col("start") + F.col("n") - 1 - F.col("last")).otherwise(F.col("carried") + F.col("n"))
    whole = F.when(F.col("seps") > 0, F.concat(F.array(F.col("carried") + F.col("head")), F.col("inner"))).otherwise(F.expr("array()").cast("array<long>"))
    whole = F.concat(whole, F.when(F.col("ends") & (rest > 0), F.array(rest)).otherwise(F.expr("array()").cast("array<long>")))
    docs = stitched.select("file", "ordinal", F.posexplode(whole).alias("i", "n_tokens"))
    return docs.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, ranks: str = RANKS, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, n_tokens) of every row: the documents are written to token files, which are then scanned."""
    spark = docs.sparkSession
    folder = scratch(spark)
    order = written(write_token_files(docs, folder, ranks, eod))
    counts = scan(spark, folder, order.select("file"), eod, block_tokens)
    # both sides grow with the corpus: neither is broadcast
    return order.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
