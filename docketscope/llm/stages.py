"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame, on rows of documents.

Cases, the same for all: an empty table gives an empty one; columns beyond those of documents are ignored, whatever
their names; texts of any length are read whole; rows without id, language or source are rows like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketscope.llm import mixing as mixing_operator
from docketscope.llm import near_dups, packing as packing_operator, pii, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the fences of their language and source.

    Null and empty texts have fewer than 20 words and go; repeated rows are judged alike.
    """
    return quality.keep_good(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies: the one with the smallest id.

    Null and empty texts are copies of one another, repeated rows are copies; of rows that share the smallest id
    and their text, one stays. A class in which no row has an id keeps one row.
    """
    return near_dups.keep_one(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by the kind in brackets.

    Null texts stay null; no row is dropped.
    """
    return _documents(pii.redact_documents(docs.select(*COLUMNS)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A row is given up to three times; a null source is one source, the last; texts without words add nothing.
    """
    return mixing_operator.repeat_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids.

    Null and empty texts are one closing id; each row of a repeated document is packed on its own.
    """
    return packing_operator.pack(docs)
