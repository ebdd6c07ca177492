"""The registered queries of the operators against their SQL, held-out accuracy, and the pipeline."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))
from oracle import connect, rows_of, sql_rows  # noqa: E402

import corpus_pipeline  # noqa: E402
from lociworks.llm import registry  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    assert rows_of(df) == sql_rows(connect(FOLDER), registry.oracle_sql()[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - {"op10_chat_format", "op12_conversation_repair"}))
def test_one_row_per_document(spark, name):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert registry.queries()[name](spark, FOLDER).select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.95), ("op8_quality", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    met = registry.queries()[name](spark, folder).where("held_out").join(labels, "doc_id").selectExpr(f"avg(cast(predicted = {label} as double)) a").first()
    assert met.a > least


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        left.append(docs.count())
    assert left == sorted(left, reverse=True) and left[-1] == left[-2] > 0
    assert corpus_pipeline.run(spark, FOLDER).count() == left[-1]
