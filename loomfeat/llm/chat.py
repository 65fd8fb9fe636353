"""Chat formatting with a grammar that round-trips.

    conversation = turn*          turn = "<|turn|>" field "<|says|>" field "<|end|>" LF
    field = "<|null|>" | text     in which a backslash takes the next character as it is

Each conversation is rendered with its text as it stands, reparsed by one deterministic parser (which splits at the marks;
no field holds "<|", so there is one way to read a conversation), and compared turn by turn with the source.  Turns
that come back different are escaped and the conversation is rendered and reparsed again, until it is identical: first a
backslash before backslashes, then also one inside each "<|".  Text that needs no escape is never touched.

Defined results: a null role or text is rendered apart from an empty one; turns are ordered by turn, role and text, nulls
first, and rows that repeat a turn are all kept; a null conv_id is a conversation of its own; an empty table has none.
All steps are SQL expressions of one grouping by conv_id; a conversation has to fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfeat.llm.shared import read

TURN, SAYS, END, NULL = "<|turn|>", "<|says|>", "<|end|>", "<|null|>"
LEVELS = 2


def escape(text: Column, level: Column | int) -> Column:
    """Level 0: as it stands; 1: backslashes doubled; 2: also "<|" broken by a backslash."""
    level = F.lit(level) if isinstance(level, int) else level
    one = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.when(level == 0, text).when(level == 1, one).otherwise(F.replace(one, F.lit("<|"), F.lit("<\\|")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def render(turns: Column) -> Column:
    """The text of an array of (role, text) as they are written."""
    field = lambda x: F.coalesce(x, F.lit(NULL))
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN), field(t["role"]), F.lit(SAYS), field(t["text"]), F.lit(f"{END}\n"))), "")


def parse(text: Column) -> Column:
    """Array of (role, text) of a rendered conversation; null if the text is not a sentence of the grammar.

    Splits at the literal marks, in time linear in the text whatever it holds.
    """
    field = lambda x: F.when(x != NULL, unescape(x))
    allowed = lambda x: (x == NULL) | ~F.contains(x, F.lit("<|"))
    parts = F.split(text, r"<\|end\|>\n", -1)
    cut = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(F.startswith(p, F.lit(TURN)).alias("begins"), F.split(F.substring(p, len(TURN) + 1, F.length(p)), r"<\|says\|>", -1).alias("f")))
    good = F.forall(cut, lambda p: p["begins"] & (F.size(p["f"]) == 2) & F.forall(p["f"], allowed)) & (F.element_at(parts, -1) == "")
    return F.when(good, F.transform(cut, lambda p: F.struct(field(p["f"][0]).alias("role"), field(p["f"][1]).alias("text"))))


def _raw(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(escape(t["role"], t["level"]).alias("role"), escape(t["text"], t["level"]).alias("text")))


def _same(a: Column, b: Column) -> Column:
    return a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered, escaped_turns, identical) of each conversation."""
    columns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    sorted_ = F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(2**62))).alias("turn"), F.col("role").isNotNull().alias("a"), F.coalesce("role", F.lit("")).alias("r"), F.col("text").isNotNull().alias("b"), F.coalesce("text", F.lit("")).alias("t"))))
    out = columns.groupBy("conv_id").agg(sorted_.alias("rows"))
    turns = F.transform("rows", lambda x: F.struct(F.when(x["a"], x["r"]).alias("role"), F.when(x["b"], x["t"]).alias("text"), F.lit(0).alias("level")))
    out = out.select("conv_id", turns.alias("turns"))
    for _ in range(LEVELS):
        # each turn is judged by the parse of its own rendering, so that a conflict cannot hide in another's turn
        def judged(t: Column) -> Column:
            back = parse(render(_raw(F.array(t))))
            fine = back.isNotNull() & (F.size(back) == 1) & _same(F.get(back, F.lit(0)), t)
            return F.struct(t["role"].alias("role"), t["text"].alias("text"), F.when(F.coalesce(fine, F.lit(False)), t["level"]).otherwise(t["level"] + 1).alias("level"))

        out = out.select("conv_id", F.transform("turns", judged).alias("turns"))
    out = out.select("conv_id", "turns", render(_raw(F.col("turns"))).alias("rendered"))
    back = parse(F.col("rendered"))
    plain = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return out.select("conv_id", F.size("turns").alias("n_turns"), "rendered", F.size(F.filter("turns", lambda t: t["level"] > 0)).alias("escaped_turns"), back.eqNullSafe(plain).alias("identical"))


#: Written from the grammar, not from the steps above: which escape a turn needs follows from what it holds.
ORACLE = r"""
WITH need AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, role, text,
    CASE WHEN contains(coalesce(role, '') || ' ' || coalesce(text, ''), '<|') THEN 2
         WHEN regexp_matches(coalesce(role, ''), '\\[\s\S]') OR regexp_matches(coalesce(text, ''), '\\[\s\S]') THEN 1 ELSE 0 END AS level
  FROM conversations),
fields AS (
  SELECT conv_id, turn, role, text, level,
    CASE level WHEN 0 THEN role WHEN 1 THEN replace(role, '\', '\\') ELSE replace(replace(role, '\', '\\'), '<|', '<\|') END AS r,
    CASE level WHEN 0 THEN text WHEN 1 THEN replace(text, '\', '\\') ELSE replace(replace(text, '\', '\\'), '<|', '<\|') END AS t
  FROM need)
SELECT conv_id, count(*)::int AS n_turns,
  string_agg('<|turn|>' || coalesce(r, '<|null|>') || '<|says|>' || coalesce(t, '<|null|>') || '<|end|>' || chr(10), ''
             ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS rendered,
  count(*) FILTER (level > 0)::int AS escaped_turns, true AS identical
FROM fields GROUP BY conv_id
"""


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(read(spark, sf_dir, "conversations"))
