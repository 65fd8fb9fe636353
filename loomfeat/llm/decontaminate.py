"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as their letters, marks and digits alone, in lower case, character by character, so that case, spacing
and punctuation make no difference.  An item of m such characters has an error budget of k = m * rate; cut in k + 1 pieces,
any occurrence with at most k edits holds one piece unchanged (pigeonhole).  One Aho-Corasick pass over each whole
text finds the pieces; where one lies, Myers' bit-parallel algorithm (1999) gives the least edit distance of the
item to any substring of the window that such an occurrence can span.  No hit and no pair is dropped.  An item too short
for an error (k = 0) counts where it stands exactly and as whole words, since its letters alone occur inside others.

Defined results: null and empty texts match nothing, and items without a letter or digit are matched by nothing; items with
equal texts are each reported; a null item_id is searched for like any other and reported as null; rows that repeat a
doc_id are one document with its least distance; null doc_ids are one document.  Extra columns, whatever their names,
are ignored by the search and kept by without_benchmark; without items or documents nothing is found.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read, written

RATE = 0.05
CHUNK_BYTES = 4_000_000  # of items in one automaton; more items make further passes over the texts
_LAST = 0x32000  # letters and digits end before


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Of each code the lower-case one, 0 for what is not compared."""
    out = np.zeros(_LAST + 1, "<u4")
    for c in range(_LAST):
        x = chr(c)
        if x.isalnum() or unicodedata.category(x)[0] == "M":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def compared(column: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each row's compared characters, and the places among them where words begin, the end included."""
    data, off = T.utf8(column)
    table = _folding()
    for a, b in T.slices(off, 1 << 20):
        part = data[off[a] : off[b]]
        first = np.r_[0, np.cumsum((part & 0xC0) != 0x80)][off[a : b + 1] - off[a]]
        codes = table[np.minimum(np.frombuffer(part.tobytes().decode().encode("utf-32-le"), "<u4"), _LAST)]
        keep = codes > 0
        begins = keep.copy()
        begins[1:] &= ~keep[:-1]
        edge = first[first < len(keep)]
        begins[edge] = keep[edge]
        at = np.r_[0, np.cumsum(keep)]
        words, at = at[np.flatnonzero(begins)], at[first]
        text = codes[keep].tobytes().decode("utf-32-le")
        cut = np.searchsorted(words, at)
        for r, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            yield text[x:y], np.append(words[cut[r] : cut[r + 1]], y) - x


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces whose lengths differ by one at most."""
    cut = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


class Pattern:
    """One item, and Myers' distance to the nearest substring of a text."""

    def __init__(self, text: str, rate: float):
        self.text, self.budget = text, int(len(text) * rate)
        self.at: dict[str, int] = {}
        for i, c in enumerate(text):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def distance(self, window: str) -> int:
        if self.text in window:
            return 0
        m = len(self.text)
        ones, high, get = (1 << m) - 1, 1 << (m - 1), self.at.get
        up, down, score, best = ones, 0, m, m
        for c in window:
            eq = get(c, 0)
            xv = eq | down
            xh = (((eq & up) + up) ^ up) | eq
            ph = down | ~(xh | up)
            mh = up & xh
            if ph & high:
                score += 1
            elif mh & high:
                score -= 1
                if score < best:
                    best = score
            ph = (ph << 1) & ones
            up = ((mh << 1) | ~(xv | ph)) & ones
            down = ph & xv
        return best


class Matcher:
    """Finds items in texts; built once a task."""

    def __init__(self, items: list[str], rate: float):
        self.patterns = [Pattern(x, rate) for x in items]
        of: dict[str, list[tuple[int, int]]] = {}
        for i, p in enumerate(self.patterns):
            for offset, piece in pieces(p.text, p.budget):
                of.setdefault(piece, []).append((i, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in of.items():
            self.automaton.add_word(piece, tuple(where))
        if of:
            self.automaton.make_automaton()

    def __call__(self, text: str, words: np.ndarray, first: bool = False) -> dict[int, int]:
        """{item: least distance} of the items within their budgets; with ``first`` no more than one of them."""
        found: dict[int, int] = {}
        if not self.patterns or not text:
            return found
        seen: dict[tuple[int, int], int] = {}
        for end, where in self.automaton.iter(text):
            for i, back in where:
                start, p = end + 1 - back, self.patterns[i]
                k = p.budget
                if found.get(i) == 0:
                    continue
                if not k:
                    if _is_in(words, start) and _is_in(words, end + 1):
                        found[i] = 0
                    continue
                # the window of an earlier start, wider by the budget, holds this one's; a cell of k + 1 places has one start
                cell = start // (k + 1)
                if any(abs(start - seen.get((i, c), start + k + 1)) <= k for c in (cell - 1, cell, cell + 1)):
                    continue
                seen[i, cell] = start
                d = p.distance(text[max(0, start - 2 * k) : start + len(p.text) + 2 * k])
                if d <= k and d < found.get(i, k + 1):
                    found[i] = d
            if first and found:
                break
        return found


def _is_in(sorted_: np.ndarray, x: int) -> bool:
    at = int(np.searchsorted(sorted_, x))
    return at < len(sorted_) and int(sorted_[at]) == x


def _chunks(benchmark: DataFrame, chunk_bytes: int) -> Iterator[tuple[list[str], list[list[int | None]]]]:
    """Parts of about ``chunk_bytes``: distinct compared texts, and the item_ids of each; the driver holds one part at a time."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // chunk_bytes)
    for n in range(parts):
        table = (items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == n) if parts > 1 else items).toArrow()
        ids: dict[str, set[int | None]] = {}
        for i, (x, _) in zip(table[0].to_pylist(), compared(table[1]), strict=True):
            if x:
                ids.setdefault(x, set()).add(i)
        texts = sorted(ids)
        if texts:
            yield texts, [sorted(ids[x], key=lambda i: (i is not None, i)) for x in texts]


_FOUND = "doc_id long, item_id long, distance int, budget int"


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, budget) of every document and item within the item's budget."""

    def scan(part: list[str], owners: list[list[int | None]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = Matcher(part, rate)
            for batch in batches:
                at, item, distance, budget = [], [], [], []
                for r, (text, words) in enumerate(compared(batch.column(1))):
                    for i, d in find(text, words).items():
                        for owner in owners[i]:
                            at.append(r), item.append(owner), distance.append(d), budget.append(find.patterns[i].budget)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(distance, pa.int32()), pa.array(budget, pa.int32())], ["doc_id", "item_id", "distance", "budget"])

        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _FOUND)

    out = None
    for n, part in enumerate(_chunks(benchmark, chunk_bytes)):
        out = scan(*part) if out is None else (written(out) if n == 1 else out).union(written(scan(*part)))
    if out is None:
        return docs.sparkSession.createDataFrame([], _FOUND)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "budget")).alias("_m")).select("doc_id", "item_id", "_m.distance", "_m.budget")


def _dirty(text: Column, part: list[str], rate: float) -> Column:
    kept: list[Matcher] = []

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        if not kept:
            kept.append(Matcher(part, rate))
        return pa.array([bool(kept[0](x, words, True)) for x, words in compared(column)], pa.bool_())

    return run(text)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows whose text holds no item, with all their columns."""
    for n, (part, _) in enumerate(_chunks(benchmark, chunk_bytes)):
        docs = (written(docs) if n else docs).filter(~_dirty(F.col("text"), part, rate))
    return docs


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
