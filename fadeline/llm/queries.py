"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fadeline.llm import archives, byte_bpe, fill_middle, fingerprints, mixing, near_duplicates, personal_data, prefix_trie, quality, secrets, sharding, toxicity, word_pieces
from fadeline.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The tokenizer files that the queries use.
BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return register


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document."""
    return near_duplicates.report(table(spark, sf_dir, "documents"))


@query("op6_sharding")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.report(table(spark, sf_dir, "documents"))


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality.report(table(spark, sf_dir, "documents"))


@query("op8_byte_bpe")
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they give again."""
    ranks = byte_bpe.load_ranks(public_tokenizers.path(BYTE_BPE))
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op1_archives", archives.ORACLE)
def op1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record of every page."""
    rows = archives.report(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri")


@query("op2_mixing", mixing.ORACLE)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document."""
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of words, word pieces and unknown words of every document."""
    opening, going_on = word_pieces.load_pieces(public_tokenizers.path(PIECES))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return word_pieces.token_counts(docs, opening, going_on).drop("text")


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.report(table(spark, sf_dir, "documents"))


@query("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of secrets in every document."""
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op11_fill_middle", fill_middle.ORACLE)
def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts, output and restored text of every document."""
    return fill_middle.report(table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", prefix_trie.ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of the rebuilt conversations."""
    return prefix_trie.report(table(spark, sf_dir, "conversations"))


@query("op13_personal_data")
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of personal data in every document."""
    return personal_data.report(table(spark, sf_dir, "documents"))
