"""A corpus pipeline of five stages; each works on all documents that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the docs of
the next.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomfeat.llm import decontaminate, neardup, pieces, pii, quality
from loomfeat.llm.shared import read, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts have the lowest score and go; repeated rows and null doc_ids are scored each for itself; an empty
    table stays empty; without labels of both classes every document with a word stays.  All columns are kept.
    """
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least doc_id.

    Null and empty texts and null doc_ids are in no group and stay; of rows that repeat a doc_id one stays; an empty table
    stays empty.  All columns are kept, whatever their names.
    """
    return neardup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget.

    Null and empty texts hold none and stay; each row is judged for itself; items are searched for whatever their id; without
    items every document stays.  All columns are kept.
    """
    return decontaminate.without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers in the text replaced by their kinds.

    Null and empty texts stay as they are; each row is redacted by its own text, so that repeated and null doc_ids make no
    difference; n_chars is counted again where that column exists.  All columns are kept.
    """
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the sampled pieces of every document, and whether they decode to its text.

    Null and empty texts have no pieces; repeated rows get equal pieces; an empty table has no rows.
    """
    return pieces.encoded(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("pieces", encode_pieces),
]

#: Learned scores, hashing, edit distance and sampling are beyond SQL; tests/llm/test_llm.py holds the stages and run() against lists.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
