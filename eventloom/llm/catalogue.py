"""Registered queries of this folder; each applies an operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from eventloom.llm import (
    conversations,
    mixing,
    neighbours,
    pieces,
    privacy,
    quality,
    queries_sql,
    repeats,
    secrets,
    simhash,
    spots,
    tokencounts,
    variants,
    warc,
)
from eventloom.llm.common import prepare, table


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words that a mix of all sources takes of every document."""
    prepare(spark)
    return mixing.mix_documents(table(spark, folder, "documents")).drop("source")


def op2_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the passages that repeat."""
    prepare(spark)
    return repeats.remove_repeats(table(spark, folder, "documents"))


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    prepare(spark)
    return pieces.encode_documents(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    prepare(spark)
    return simhash.near_groups(table(spark, folder, "documents"))


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    prepare(spark)
    return secrets.find_secrets(table(spark, folder, "documents"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Record type and payload of every page, read back from deduplicated archives."""
    prepare(spark)
    return warc.archive_pages(table(spark, folder, "pages"))


def op7_private(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document, with the terms that disclose it."""
    prepare(spark)
    return privacy.find_private(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    prepare(spark)
    return quality.score_documents(
        table(spark, folder, "documents"), table(spark, folder, "labels")
    )


def op9_spots(spark: SparkSession, folder: str) -> DataFrame:
    """Spot signatures of every document, of an edited text, and their likeness."""
    prepare(spark)
    return spots.fingerprint_documents(table(spark, folder, "documents"))


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, by inner product."""
    prepare(spark)
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op11_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    prepare(spark)
    return tokencounts.count_tokens(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of every damaged conversation, and its cheapest repair."""
    prepare(spark)
    return conversations.repair_conversations(table(spark, folder, "conversations"))


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with the commoner word that it is a variant of."""
    prepare(spark)
    return variants.spelling_variants(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of the documents that come through all stages."""
    return corpus_pipeline.run(spark, folder)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_repeats": op2_repeats,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_simhash": op4_simhash,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_private": op7_private,
    "op8_quality": op8_quality,
    "op9_spots": op9_spots,
    "op10_neighbours": op10_neighbours,
    "op11_tokens": op11_tokens,
    "op12_conversations": op12_conversations,
    "op13_variants": op13_variants,
    "pipeline": pipeline,
}

ORACLES = {
    "op1_mixing": queries_sql.OP1_MIXING,
    "op6_warc": queries_sql.OP6_WARC,
}
