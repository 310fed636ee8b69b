"""A corpus, from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of ``docs``; the last returns the packing.

Rows with null ids or texts, empty and very long texts, and rows that repeat go through every stage; further columns stay as they are, whatever their names. A
table without rows gives none. Where there is nothing to learn from, the two classifiers keep all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noticeflow.llm import jaccard, packing, quality, secrets, toxicity
from noticeflow.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. A null or empty text is judged by the intercept; equal texts have one fate; a tie at the threshold goes."""
    return toxicity.keep(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null or empty text is judged by the bias; equal texts have one fate; a tie at the threshold stays."""
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that of the smallest id, nulls last; of one id's texts the one of least hash; of equal rows one.

    Null and blank texts have nothing that could be alike, so their rows all stay.
    """
    return jaccard.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every row stays, null and empty texts as they are, and n_chars counts the new text if it is a number."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 1024 tokens; a null or empty text is one end token, a long one several pieces, and each row its own."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: Learned models and subword tokens can't be written in SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
