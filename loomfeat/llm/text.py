"""Byte-level kernels over Arrow string columns, shared by the text operators.

All of them read the UTF-8 buffer of a whole batch with NumPy, so that the cost of a document is a
few nanoseconds a byte and no Python string is made.  A null text counts as the empty text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; elsewhere nothing is done
MULT = 0x9E3779B97F4A7C15 | 1
_POW_LEN = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit words, used for every hash and random number here."""
    x = x.astype(_U, copy=True)
    x += _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], _U))[0])


def _luts() -> tuple[np.ndarray, np.ndarray]:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = True
    word[128:] = True
    return low, word


LOWER, WORD = _luts()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes; a longer row is a range of its own, never cut."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b
    trim()


def trim() -> None:
    """Give memory that was freed back to the system: an executor's workers live on while others of it need more."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters U+00C0 to U+00DE."""
    low = LOWER[data]
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3)) + 1
        second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
        low[second] += 0x20
    return low


class Words:
    """Words (runs of letters, digits and non-ASCII bytes, case folded) of the rows of one slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.rows = len(offsets) - 1
        low, is_word = fold(data), WORD[data]
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = is_word[:-1]
            after[:-1] = is_word[1:]
            edge = offsets[(offsets > 0) & (offsets < n)]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(is_word & ~before)
        self.end = np.flatnonzero(is_word & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)  # of each row, and the end
        self.hash = span_hash(low, self.start, self.end)


class Spans:
    """Hashes of spans of one buffer."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = (self.sums[end] - self.sums[start]) * self.inverse[start]
        out ^= (end - start).astype(_U) * _U(0xD6E8FEB86659FD93)
        return mix(out)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span lies."""
    return Spans(data)(start, end) if len(start) else np.zeros(0, _U)


_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("p", ())) < n:
        size = max(n, _POW_LEN)
        for key, base in (("p", MULT), ("i", pow(MULT, -1, 1 << 64))):
            x = np.full(size, base, _U)
            x[0] = 1
            _cache[key] = np.cumprod(x, dtype=_U)
    return _cache["p"][:n], _cache["i"][:n]


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct word n-grams of each row, in the order of the rows; at most 2^24 rows.

    A row with fewer words than ``size`` has one shingle of all its words, and none if it has no word.
    """
    count = np.diff(words.first)
    h, row, n = words.hash, words.row, len(words.hash)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    out = np.zeros(n, _U)
    left = words.first[row + 1] - np.arange(n)
    for k in range(size):
        ok = left > k
        term = np.zeros(n, _U)
        term[: n - k if k else n] = h[k:] if k else h
        out = np.where(ok, mix(out * _U(31) + term), out)
    keep = (left >= size) | ((count[row] < size) & (left == count[row]))
    # one sort of row and hash together; 40 bits of the hash stay, which is enough to tell a row's shingles apart
    key = np.sort((row[keep].astype(_U) << _U(40)) | (out[keep] >> _U(24)))
    key = key[np.r_[True, key[1:] != key[:-1]]]
    return (key >> _U(40)).astype(np.int64), mix(key & _U((1 << 40) - 1))
