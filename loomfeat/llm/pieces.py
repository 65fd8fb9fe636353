"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for each vocabulary piece.  Forward filtering
sums the weights of all paths to each node; backward sampling draws an edge into the current node in proportion, from
the end to the start, which samples whole segmentations exactly by their probability (Kudo 2018).  The model is a BPE
one whose scores are ranks, so that a piece of rank r gets the probability of Zipf's law, 1 / (r + ZIPF), raised to ALPHA.
Characters without a piece of their own fall back to their bytes.

Texts factorise exactly where no piece holds two adjacent characters (at every space, for one), so that each distinct
chunk of a slice is filtered once and all its occurrences are sampled together, in NumPy.  The uniform numbers are a hash
of the seed, the row's doc_id and the position: results do not depend on partitions, batches or retries.

Defined results: null and empty texts have no pieces and decode to the empty text; the sign U+2581 is kept apart from
the space by its bytes; a null doc_id is the key 0 with a flag of its own; repeated rows get equal segmentations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, ZIPF, SEED = 0.5, 2.7, 1
SLICE_BYTES = 1 << 20
_U = np.uint64
_SPACE, _SIGN = 0x2581, 0x110000  # the sign itself becomes a code beyond Unicode until its bytes are written
_FALLBACK = 1 << 22
_BITS = 18


class Model:
    def __init__(self, path: str, alpha: float = ALPHA, zipf: float = ZIPF):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.id: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                self.bytes[i] = piece.replace("▁", " ").encode()
        rank = np.array([-sp.get_score(i) for i in self.id.values()])
        log = -np.log(rank + zipf)
        log -= np.logaddexp.reduce(log)
        self.log = np.full(n, -np.inf)
        self.log[list(self.id.values())] = alpha * log
        self.fallback = alpha * (log.min() - 10)
        self.longest = max(map(len, self.id))
        self._table([(p, i) for p, i in self.id.items() if len(p) > 1])
        self.one = np.full(_SIGN + 1, -1, np.int32)  # the piece of a single character
        for piece, i in self.id.items():
            if len(piece) == 1:
                self.one[ord(piece)] = i
        code = np.zeros(_SIGN + 1, np.uint16)
        letters = sorted({c for p in self.id if len(p) > 1 for c in p})
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.code = code
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.id:
            for a, b in zip(p[:-1], p[1:], strict=True):
                self.joined[code[ord(a)], code[ord(b)]] = True
        self.byte_start = np.r_[0, np.cumsum([len(b) for b in self.bytes])]
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def _table(self, pieces: list[tuple[str, int]]) -> None:
        """An open hash table of the pieces with several characters, by the hash of their codes."""
        chars = np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le"), "<u4")
        end = np.cumsum([len(p) for p, _ in pieces])
        hashes = T.span_hash(chars, np.r_[0, end[:-1]], end)
        self.slots, self.owner = np.zeros(1 << _BITS, _U), np.zeros(1 << _BITS, np.int32)
        self.probes = 1
        for h, (_, i) in zip(hashes.tolist(), pieces, strict=True):
            at, probe = h >> (64 - _BITS), 1
            while self.slots[at]:
                at, probe = (at + 1) & ((1 << _BITS) - 1), probe + 1
            self.slots[at], self.owner[at] = h, i
            self.probes = max(self.probes, probe)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        at = (hashes >> _U(64 - _BITS)).astype(np.int64)
        out = np.full(len(hashes), -1, np.int32)
        todo = np.flatnonzero(self.slots[at])
        for _ in range(self.probes):
            same = self.slots[at[todo]] == hashes[todo]
            out[todo[same]] = self.owner[at[todo[same]]]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & ((1 << _BITS) - 1)
            todo = todo[self.slots[at[todo]] != 0]
            if not len(todo):
                break
        return out

    def lattice(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end node, length, piece) of all edges; ``left`` is how many characters of its chunk begin at each place."""
        hasher = T.Spans(chars)
        at = np.flatnonzero(left > 0)
        one = self.one[chars[at]]
        alone = one < 0
        ends, pieces, sizes = [at + 1], [np.where(alone, _FALLBACK + chars[at].astype(np.int64), one)], [np.ones(len(at), np.int64)]
        for size in range(2, self.longest + 1):
            at = at[left[at] >= size]
            if not len(at):
                break
            found = self.lookup(hasher(at, at + size))
            hit = np.flatnonzero(found >= 0)
            ends.append(at[hit] + size)
            pieces.append(found[hit].astype(np.int64))
            sizes.append(np.full(len(hit), size, np.int64))
        return np.concatenate(ends), np.concatenate(sizes), np.concatenate(pieces)


@lru_cache(maxsize=4)
def load(path: str, alpha: float = ALPHA, zipf: float = ZIPF) -> Model:
    return Model(path, alpha, zipf)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0], and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def _distinct(chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct chunk, which distinct chunk each is); compared in full, not by hash alone."""
    _, first, which = np.unique(T.span_hash(chars, start, end), return_index=True, return_inverse=True)
    size = end - start
    twin = start[first][which]
    if (size != size[first][which]).any() or (chars != chars[_ranges(twin, size)]).any():
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(chars[a:b].tobytes(), len(seen)) for a, b in zip(start, end, strict=True)])
        first = np.unique(which, return_index=True)[1]
    return first, which


class Filtered:
    """The lattices of distinct chunks after forward filtering: nodes, and the edges into each by cumulative share."""

    def __init__(self, model: Model, chars: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start
        joined = np.full(int(size.sum()) + len(size), 10, np.uint32)  # a line feed, which is in no piece, between chunks
        self.begin = np.r_[0, np.cumsum(size + 1)[:-1]]
        self.end = self.begin + size
        joined[_ranges(self.begin, size)] = chars[_ranges(start, size)]
        place = np.arange(len(joined))
        left = np.repeat(self.end, size + 1) - place
        into, length, piece = model.lattice(joined, left)
        depth = (place - np.repeat(self.begin, size + 1))[into]
        # nodes at equal depth are filtered together; one sort of depth, node and length
        order = np.argsort((depth << 36) | (into << 5) | length)
        into, piece, depth = into[order], piece[order], depth[order]
        source = into - length[order]
        weight = np.where(piece < _FALLBACK, model.log[np.minimum(piece, len(model.log) - 1)], model.fallback)
        self.total = np.zeros(len(joined))
        share = np.empty(len(into))
        first = np.flatnonzero(np.r_[True, into[1:] != into[:-1]]) if len(into) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(into)] - 1
        groups = np.searchsorted(depth[first], np.arange(1, (depth[-1] if len(depth) else 0) + 2))
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            lo, hi = first[a], last[b - 1] + 1
            value = self.total[source[lo:hi]] + weight[lo:hi]
            at, count = first[a:b] - lo, last[a:b] - first[a:b] + 1
            top = np.maximum.reduceat(value, at)
            part = np.exp(value - np.repeat(top, count))
            whole = np.add.reduceat(part, at)
            self.total[into[first[a:b]]] = top + np.log(whole)
            share[lo:hi] = part / np.repeat(whole, count)
        running = np.cumsum(share)
        before = np.repeat(np.r_[0, running][first], last - first + 1)
        self.upto = running - before
        self.upto[last] = 2.0
        self.source, self.piece = source, piece
        self.first = np.zeros(len(joined), np.int64)
        self.first[into[first]] = first

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge into each node that a uniform number picks."""
        edge = self.first[node]
        go = np.flatnonzero(u >= self.upto[edge])
        while len(go):
            edge[go] += 1
            go = go[u[go] >= self.upto[edge[go]]]
        return edge


def characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets) with spaces as their sign, and one before each text that is not empty."""
    begins = (data & 0xC0) != 0x80
    at = np.r_[0, np.cumsum(begins)][off]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    some = at[1:] > at[:-1]
    chars = np.where(chars == _SPACE, _SIGN, np.where(chars == 32, _SPACE, chars))
    chars = np.insert(chars, at[:-1][some], _SPACE).astype(np.uint32)
    return chars, at + np.r_[0, np.cumsum(some)]


def encode(model: Model, data: np.ndarray, off: np.ndarray, keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, offsets) of sampled segmentations of the texts; ``keys`` is a 64-bit number of each row."""
    chars, at = characters(data, off)
    n = len(chars)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    code = model.code[chars]
    cut = np.ones(n, bool)
    cut[1:] = ~model.joined[code[:-1], code[1:]]
    cut[at[at < n]] = True
    start = np.flatnonzero(cut)
    end = np.r_[start[1:], n]
    first, which = _distinct(chars, start, end)
    lattice = Filtered(model, chars, start[first], end[first])
    row = np.searchsorted(at, start, "right") - 1
    salt = T.mix(keys.astype(_U) ^ _U(T.mix_int(seed)))[row]
    node, stop, pos = lattice.end[which], lattice.begin[which], end.copy()
    shift = at[row]
    chosen = np.full(n + 1, -1, np.int64)
    while len(node):
        u = (T.mix(salt + (pos - shift).astype(_U) * _U(T.MULT)) >> _U(11)).astype(float) * 2.0**-53
        edge = lattice.draw(node, u)
        chosen[pos] = lattice.piece[edge]
        before = lattice.source[edge]
        pos = pos - (node - before)
        node = before
        go = node > stop
        if not go.all():
            node, stop, pos, salt, shift = node[go], stop[go], pos[go], salt[go], shift[go]
    took = chosen >= 0
    per_row = np.r_[0, np.cumsum(took[1:])][at]
    pieces = chosen[took]
    odd = np.flatnonzero(pieces >= _FALLBACK)
    if not len(odd):
        return pieces.astype(np.int32), per_row
    raw = [chr(c if c != _SIGN else _SPACE).encode() for c in (pieces[odd] - _FALLBACK).tolist()]
    count = np.ones(len(pieces), np.int64)
    count[odd] = [len(b) for b in raw]
    to = np.r_[0, np.cumsum(count)]
    out = np.repeat(pieces, count)
    out[_ranges(to[odd], count[odd])] = model.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
    return out.astype(np.int32), to[per_row]


def decode(model: Model, pieces: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts: the pieces' bytes without the space that encoding put before each."""
    size = model.byte_start[pieces + 1] - model.byte_start[pieces]
    data = model.byte_flat[_ranges(model.byte_start[pieces], size)]
    at = np.r_[0, np.cumsum(size)][off]
    some = at[1:] > at[:-1]
    return np.delete(data, at[:-1][some]), at - np.r_[0, np.cumsum(some)]


def _keys(column: pa.Array) -> np.ndarray:
    known = np.asarray(column.is_valid())
    ids = np.asarray(column.fill_null(0)).astype(np.int64).view(_U)
    return T.mix(ids) ^ np.where(known, _U(0), _U(0x5851F42D4C957F2D))


def _encode(path: str, alpha: float, seed: int, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, alpha)
        for batch in batches:
            data, off = T.utf8(batch.column(1))
            keys = _keys(batch.column(0))
            for a, b in T.slices(off, SLICE_BYTES):
                part, at = data[off[a] : off[b]], off[a : b + 1] - off[a]
                pieces, to = encode(model, part, at, keys[a:b], seed)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(to.astype(np.int32), pa.array(pieces)), pa.array(np.diff(to).astype(np.int32))]
                names = ["doc_id", "pieces", "n_pieces"]
                if check:
                    back, where = decode(model, pieces, to)
                    same = np.diff(where) == np.diff(at)
                    if not (same.all() and np.array_equal(back, part)):
                        same = np.array([np.array_equal(back[where[i] : where[i + 1]], part[at[i] : at[i + 1]]) for i in range(b - a)], bool)
                    columns.append(pa.array(same))
                    names.append("lossless")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encoded(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, check: bool = True) -> DataFrame:
    """(doc_id, pieces, n_pieces) of every row, and with ``check`` whether decoding gave the text back."""
    kinds = "doc_id long, pieces array<int>, n_pieces int" + ", lossless boolean" * check
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode(model, alpha, seed, check), kinds)


def decoded(pieces: Column, model: str = MODEL) -> Column:
    """The text of a column of pieces."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        off = np.r_[0, np.cumsum(np.asarray(pa.compute.list_value_length(column).fill_null(0)))]
        data, at = decode(load(model), np.asarray(column.flatten()).astype(np.int64), off)
        return pa.array([data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())

    return run(pieces)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents"))
