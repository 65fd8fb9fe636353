"""Personal data by bootstrapped contextual extraction.

Candidates are identifier-like spans (with a digit or an at sign).  Strict validators give the seed entities of each
kind: mail addresses, IPv4 addresses, telephone numbers, payment cards with a right check digit, 40-digit hex
secrets.  Every occurrence induces lexical patterns: its shape, its left words, and the words on both sides, the
latter with a coarse class of the value.  Patterns and instances make a bipartite graph that Spark scores in turns:
a pattern's score for a kind is pos / (pos + neg + UNKNOWN_WEIGHT * unknown) over its distinct instances, an
instance's confidence is the noisy-or of its confident patterns; instances found in one turn count in the next.
An occurrence is reported if it is a seed or if the noisy-or of its own patterns reaches the threshold, so that
cards with a wrong check digit or truncated secrets are found by what they have in common with the seeds.

Defined results: null and empty texts have no occurrences; offsets count characters of the whole text; rows that
repeat a doc_id and its text give each occurrence once; ties between kinds go to the first by name; a null doc_id is reported
as null.  Redaction works row by row, needs no doc_id, and sets n_chars where that column exists.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm import text as T
from loomfeat.llm.shared import read, written

THRESHOLD, MIN_SUPPORT, UNKNOWN_WEIGHT, TURNS = 0.5, 3, 0.05, 3
LOCAL_PATTERNS = 200_000  # patterns that tasks hold themselves; beyond, occurrences are joined with them

_SPAN = re.compile(
    r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]\d{2,4}){1,3}(?!\d)|\(?(?<!\d)\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}(?!\d)|[^\s\"'<>()\[\]{},;=]*[@\d][^\s\"'<>()\[\]{},;=]*"
)
_EDGE = "#$%&*!.,;:|?~_"
_MAIL = re.compile(r"[A-Za-z0-9_+\-À-ɏ][\w.+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}")
_PHONE = re.compile(r"\+1 ?\(?\d{3}\)?[ .\-]\d{3}[ .\-]\d{4}")
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_SECRET = re.compile(r"(?=[^a-f]*[a-f])(?=[^0-9]*[0-9])[0-9a-f]{40}")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[^\s\"'=]+|[\"'=]")
_LETTERS = re.compile(r"[^\W\d_]+")
_NEAR = 120  # characters looked at first for the words around; more if these do not hold them
_MARK = np.zeros(256, bool)
_MARK[48:58] = True
_MARK[64] = True


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def seed_kind(value: str) -> str | None:
    """The kind of a value that passes a strict validator."""
    if "@" in value:
        return "email" if _MAIL.fullmatch(value) else None
    if _IP.fullmatch(value):
        return "ip"
    if _PHONE.fullmatch(value):
        return "phone"
    if len(value) in (15, 16) and value.isascii() and value.isdigit():
        return "card" if luhn(value) else None
    return "secret" if _SECRET.fullmatch(value) else None


def shape(value: str) -> str:
    if _HEX.fullmatch(value) and not value.isdigit():
        return f"HEX{len(value)}"
    if "@" in value:
        return re.sub(r"(?:A|D)+", "W", _LETTERS.sub("A", _DIGITS.sub("D", value)))
    out = _LETTERS.sub("A", value)
    return _DIGITS.sub(lambda m: "D" if len(m.group()) < 5 else f"D{len(m.group())}", out)


def coarse(value: str) -> str:
    if "@" in value:
        return "mail"
    if _HEX.fullmatch(value) and not value.isdigit():
        return "hex"
    n = sum(c.isdigit() for c in value)
    kind = "letters" if any(c.isalpha() for c in value) else "dots" if "." in value else "digits"
    return f"{kind}{'+' if n > 5 else '-'}"


def _words(text: str) -> list[str]:
    return [_DIGITS.sub("0", x.strip(_EDGE).lower() or x[:3]) for x in _WORD.findall(text)]


def _before(text: str, start: int) -> list[str]:
    """The three words before a place, or as many as there are, each whole."""
    size = _NEAR
    while True:
        found = _words(text[max(0, start - size) : start])
        if start <= size or len(found) > 3:
            return found[-3:]
        size *= 4


def _after(text: str, end: int) -> list[str]:
    """The word after a place, whole, or none at the end."""
    m = _WORD.search(text, end)
    return _words(m.group()) if m else []


def occurrences(text: str) -> Iterator[tuple[int, int, str, str | None, list[str]]]:
    """(start, end, value, seed kind, patterns) of the identifier-like spans."""
    for m in _SPAN.finditer(text):
        start, end = m.span()
        value = m.group()
        short = value.lstrip(_EDGE)
        start += len(value) - len(short)
        value = short.rstrip(_EDGE)
        end = start + len(value)
        if not value or not _mark(value):
            continue
        left, right = _before(text, start), _after(text, end)
        kind = coarse(value)
        found = [f"shape {shape(value)}", f"left {' '.join(left[-2:])} [{kind}]", f"around {' '.join(left[-1:])} [{kind}] {' '.join(right)}"]
        if len(left) == 3:
            found.append(f"left {' '.join(left)} [{kind}]")
        yield start, end, value, seed_kind(value), found


def _mark(value: str) -> bool:
    return "@" in value or any(c.isdigit() for c in value)


def _marked(column: pa.Array) -> np.ndarray:
    """Rows whose text has an ASCII digit or an at sign."""
    data, off = T.utf8(column)
    total = np.r_[0, np.cumsum(_MARK[data])]
    return np.flatnonzero(total[off[1:]] > total[off[:-1]])


_OCCURRENCE = "doc_id long, start int, end int, value string, seed string, patterns array<string>"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for r in _marked(batch.column(1)).tolist():
            for one in occurrences(batch.column(1)[r].as_py()):
                for column, x in zip(rows, (r, *one), strict=True):
                    column.append(x)
        if rows[0]:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), *(pa.array(x, k) for x, k in zip(rows[1:], kinds, strict=True))], ["doc_id", "start", "end", "value", "seed", "patterns"])


def extract(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_extract, _OCCURRENCE)


def pattern_scores(found: DataFrame, threshold: float = THRESHOLD, min_support: float = MIN_SUPPORT, unknown_weight: float = UNKNOWN_WEIGHT, turns: int = TURNS) -> DataFrame:
    """(pattern, kind, score) of the confident patterns, after ``turns`` turns over the graph of all occurrences."""
    edges = written(found.select("value", "seed", F.explode("patterns").alias("pattern")).distinct())
    total = written(edges.groupBy("pattern").agg(F.count("*").alias("n")))
    seeds = edges.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("confidence")).distinct()
    confidence = seeds
    for turn in range(turns):
        by = edges.join(confidence, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("pos"))
        # what the other kinds claim, and what none does
        claimed = by.groupBy("pattern").agg(F.sum("pos").alias("claimed"))
        scores = by.filter(F.col("pos") >= min_support).join(claimed, "pattern").join(total, "pattern")
        unknown = F.greatest(F.col("n") - F.col("claimed"), F.lit(0.0))
        scores = scores.select("pattern", "kind", F.round(F.col("pos") / (F.col("claimed") + unknown_weight * unknown), 9).alias("score"))
        scores = written(scores.filter(F.col("score") >= threshold))
        if turn == turns - 1:
            break
        grown = edges.filter("seed is null").join(scores, "pattern").groupBy("value", "kind").agg(_noisy_or("score").alias("confidence"))
        confidence = written(seeds.union(grown.filter(F.col("confidence") >= threshold)))
    return scores


def _noisy_or(column: str) -> Column:
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - F.coalesce(F.col(column), F.lit(0.0)), F.lit(1e-9)))))


def _decided(found: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Each distinct occurrence that is a seed or reaches the threshold, with its kind and score."""
    key = ["doc_id", "start", "end", "value", "seed"]
    scores = F.broadcast(scores) if scores.count() <= LOCAL_PATTERNS else scores
    hits = found.dropDuplicates(key).select(*key, F.explode("patterns").alias("pattern")).join(scores, "pattern", "left")
    by_kind = hits.groupBy(*key, "kind").agg(_noisy_or("score").alias("s"))
    one = by_kind.groupBy(*key).agg(F.min(F.when(F.col("kind").isNotNull(), F.struct((-F.col("s")).alias("s"), "kind"))).alias("best"))
    score = F.when(F.col("seed").isNotNull(), 1.0).otherwise(F.round(-F.col("best.s"), 6))
    return one.select("doc_id", "start", "end", F.coalesce("seed", "best.kind").alias("kind"), "value", score.alias("score"), F.col("seed").isNotNull().alias("is_seed")).filter(F.col("score") >= threshold)


def personal_data(docs: DataFrame, threshold: float = THRESHOLD, **params: float) -> DataFrame:
    """(doc_id, start, end, kind, value, score, is_seed) of every identifier found."""
    found = written(extract(docs))
    return _decided(found, pattern_scores(found, threshold, **params), threshold)


def decide(seed: str | None, patterns: list[str], scores: dict[str, list[tuple[str, float]]], threshold: float) -> str | None:
    """The kind of one occurrence, or None."""
    if seed:
        return seed
    logs: dict[str, float] = {}
    for p in patterns:
        for kind, s in scores.get(p, ()):
            logs[kind] = logs.get(kind, 0.0) + math.log(max(1 - s, 1e-9))
    if not logs:
        return None
    kind = min(logs, key=lambda k: (logs[k], k))
    return kind if 1 - math.exp(logs[kind]) >= threshold else None


def mask(text: str, scores: dict[str, list[tuple[str, float]]], threshold: float) -> str:
    out, last = [], 0
    for start, end, _, seed, patterns in occurrences(text):
        kind = decide(seed, patterns, scores, threshold)
        if kind:
            out += [text[last:start], f"[{kind.upper()}]"]
            last = end
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, threshold: float = THRESHOLD, local_patterns: int = LOCAL_PATTERNS, **params: float) -> DataFrame:
    """All rows and columns, with the identifiers in ``text`` replaced by their kinds in brackets."""
    found = written(extract(docs))
    confident = pattern_scores(found, threshold, **params)
    if confident.count() > local_patterns:
        return _redact_by_join(docs, confident, threshold)
    scores: dict[str, list[tuple[str, float]]] = {}
    for r in confident.collect():
        scores.setdefault(r["pattern"], []).append((r["kind"], r["score"]))

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        rows = _marked(column)
        if not len(rows):
            return column
        texts = column.to_pylist()
        for r in rows.tolist():
            texts[r] = mask(texts[r], scores, threshold)
        out = pa.array(texts, pa.string())
        del texts
        T.trim()
        return out

    return _with_text(docs, run(F.col("text")))


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    docs = docs.withColumn("text", text)
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, patterns = [], []
        for r in _marked(batch.column(1)).tolist():
            own = {p for *_, found in occurrences(batch.column(1)[r].as_py()) for p in found}
            keys += [r] * len(own)
            patterns += own
        if keys:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), pa.array(patterns, pa.string())], ["_of", "pattern"])


def _redact_by_join(docs: DataFrame, confident: DataFrame, threshold: float) -> DataFrame:
    """The same where the patterns are too many for a task: each text meets those it holds, by a digest of the text.

    A row's mask depends on its text alone, so rows of one text share their patterns and no doc_id is needed.
    """
    digest = F.sha2("text", 256)
    own = docs.filter("text is not null").select(digest.alias("_of"), "text").mapInArrow(_patterns, "_of string, pattern string").distinct()
    scores = own.join(confident, "pattern").groupBy("_of").agg(F.collect_list(F.struct("pattern", "kind", "score")).alias("_scores"))

    @F.arrow_udf("string")
    def run(texts: pa.Array, scores: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for r in _marked(texts).tolist():
            of: dict[str, list[tuple[str, float]]] = {}
            for x in scores[r].as_py() or ():
                of.setdefault(x["pattern"], []).append((x["kind"], x["score"]))
            out[r] = mask(out[r], of, threshold)
        return pa.array(out, pa.string())

    joined = docs.withColumn("_of", digest).join(scores, "_of", "left")
    return _with_text(joined, run(F.col("text"), F.col("_scores"))).select(*docs.columns)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
