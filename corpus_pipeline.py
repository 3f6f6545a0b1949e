"""From raw documents to token ids: judge, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written and read again before the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import mixing, pieces, privacy, quality, simhash
from eventloom.llm.common import prepare, table
from eventloom.session import materialise

MODEL = "piece_bpe_32k.model"


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    prepare(spark)
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group, that with the smallest doc_id.

    Near means that 0.8 or more of the different shingles of five words of two texts are
    the same. Candidates come from sixteen SimHashes, and are verified on the shingles.
    """
    prepare(spark)
    return simhash.one_of_each(docs, shingle=5)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms replaced in the text."""
    prepare(spark)
    return privacy.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights; a document may be there twice."""
    prepare(spark)
    return mixing.mixed_corpus(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, and digests of ids and decoded text."""
    prepare(spark)
    return pieces.encode_documents(docs, public_tokenizers.path(MODEL), keep_ids=True)


STAGES = [
    ("quality classifier", judge),
    ("SimHash near-dedup", deduplicate),
    ("PII", redact),
    ("mixing sources", mix),
    ("SentencePiece", encode),
]

#: SQL cannot score with trees or merge pieces; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
