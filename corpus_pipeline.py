"""A training-data pipeline over the documents table, from quality filter to packed sequences.

Every stage but the last returns the columns it was given, whatever they are called, and takes nulls in any of them, empty
and very long texts, rows that repeat and empty tables, which give empty tables. Each says below what becomes of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.decontamination import drop_contaminated
from seqlake.llm.jaccard_join import drop_near_copies
from seqlake.llm.packing import pack
from seqlake.llm.pii import sanitise
from seqlake.llm.quality_lm import drop_low_quality
from seqlake.llm.queries import table, tokenizer
from seqlake.llm.words import durable

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for trusted text of their language.

    Null and empty texts go; a null language is one by itself; repeated rows are judged alike and all stay or go; a text at the
    limit stays. Without labels all other texts stay.
    """
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-copies: the one with the least id.

    Null and empty texts are one class. Of repeated rows one stays; a null id comes after all others; of rows with one id and
    different texts the one with the least hash of both stays.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, re-parameterised ones too.

    Null and empty texts stay; repeated rows stay or go together; a share of windows equal to the limit counts as found.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced; n_chars, if there, is counted anew.

    All rows stay; a null text stays null, and so does its n_chars; repeated rows are replaced alike.
    """
    clean = sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens go in sequences of 2048, in columns of its own: a row for each piece.

    Null and empty texts are their end id alone; repeated rows are packed one by one; null ids stay null.
    """
    return pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, with every earlier one kept in a durable table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = durable(docs)
    return docs
