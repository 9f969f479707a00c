"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame with the columns of ``docs``; the last one returns the ids.  Every
stage's result is written as Parquet in the shared work folder and read again, so
a lost executor costs no more than the stage it was in.

In all stages a null text counts as empty, rows without a doc_id are rows like others,
further columns go along whatever they are called, equal rows are rows of their own
unless it says otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fadeline.llm import byte_bpe, mixing, near_duplicates, secrets, toxicity
from fadeline.llm.queries import BYTE_BPE
from fadeline.llm.text import table
from fadeline.session import staged


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; learned from the labels of ``sf_dir``.

    Empty texts are scored like others.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the smallest doc_id, of equal rows
    the one with the smallest other columns.  Empty texts are one class."""
    return near_duplicates.without_near_duplicates(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts; ``n_chars`` follows the text.  A null
    text stays null."""
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken.  A null source is a source;
    documents without words are taken like others of their source."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (little-endian 32-bit integers), their number, and the
    digest of the bytes they decode to; a null or empty text has no ids."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    rows = byte_bpe.encode(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, decoded="decoded")
    return rows.select("doc_id", "source", "ids", F.expr("length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("secrets", without_secrets), ("mixing", mixed), ("byte_bpe", encoded)]

#: Neighbours, samples and merges are not expressible in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` on."""
    rows = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        rows = staged(stage(spark, rows, sf_dir))
    return rows
