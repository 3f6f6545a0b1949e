"""The pipeline, stage by stage, against what each stage must do to its own input."""

from __future__ import annotations

from array import array

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from eventloom.llm import mixing
from eventloom.session import materialise
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    found = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], FOLDER)))
    return found


def test_columns_and_order(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "PII", "mixing sources", "SentencePiece",
    ]
    for step in steps[1:-1]:
        assert step.dtypes == steps[0].dtypes
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in driver.oracle_sql()


def test_clean_documents_stay(spark, steps):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality").toPandas()
    kept = {r[0] for r in steps[1].select("doc_id").collect()}
    assert kept >= set(labels[labels["quality"] == 1]["doc_id"])
    bad = set(labels[labels["quality"] == 0]["doc_id"])
    assert len(bad & kept) <= 0.05 * len(bad)


def test_one_of_each_group_stays(steps):
    before, after = (s.toPandas() for s in steps[1:3])
    assert after["doc_id"].is_unique and set(after["doc_id"]) <= set(before["doc_id"])
    # No text is there twice, and of every text one copy or a near one is.
    assert after["text"].is_unique
    firsts = before.groupby("text")["doc_id"].min()
    gone = firsts[~firsts.isin(after["doc_id"])]
    assert len(gone) < 0.1 * len(firsts)


def test_personal_data_goes(steps):
    before, after = (s.select("doc_id", "text", "n_chars").toPandas().set_index("doc_id") for s in steps[2:4])
    assert len(before) == len(after)
    for i, text in before["text"].items():
        clean = after.loc[i, "text"]
        if brute.private(text)[1] == "":
            assert clean == text
        else:
            assert brute.private(clean)[1] == "" and "[" in clean
            assert after.loc[i, "n_chars"] == len(clean)


def test_mix_is_what_the_operator_takes(steps):
    taken = mixing.mix_documents(steps[3]).where("size > 0").select(
        "doc_id", (F.col("taken") / F.col("size")).cast("long").alias("n")
    )
    want = {r["doc_id"]: r["n"] for r in taken.collect() if r["n"]}
    got = {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == want


def test_tokens_are_those_of_the_library(steps):
    model = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path(corpus_pipeline.MODEL)
    )
    text = {r["doc_id"]: r["text"] for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        ids = model.encode(text[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.digest(array("I", ids).tobytes())
        assert r["decoded_sha256"] == brute.digest(model.decode(ids))


def test_edges_pass_through(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id", "en", "a", 5), (3, "x " * 4000, "en", "b", 8000), (3, "x " * 4000, "en", "b", 8000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for frame in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            frame = materialise(stage(spark, frame, FOLDER))
        assert frame.count() <= 2 * len(rows)
