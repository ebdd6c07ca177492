"""Joins whose sides grow with the input don't pass through the driver, however small Spark takes these to be."""

from __future__ import annotations

from cases import benchmark, documents
from pyspark.sql import functions as F

from lociworks.llm import decontamination, simhash


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_candidates_are_joined_by_shuffles(spark):
    """70 keys a fingerprint are sized as one."""
    found = simhash.candidate_links(spark.range(40).selectExpr("id * 2 as fp"))
    assert broadcasts(found) == 0 and found.count() > 0


def test_components_are_joined_by_shuffles(spark, monkeypatch):
    """what is joined to documents and fingerprints where components are many."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", -1)
    plain = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}
    seen, real = [], simhash.checkpointed
    monkeypatch.setattr(simhash, "checkpointed", lambda df: seen.append(broadcasts(df)) or real(df))
    for made in (simhash.near_duplicates, simhash.keep_one):
        found = made(documents(spark))
        assert not any(seen) and broadcasts(found) == 0
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 10**6)
    assert plain == {(r.doc_id, r.component_id) for r in simhash.near_duplicates(documents(spark)).collect()}


def test_a_large_vocabulary_is_joined_by_a_shuffle(spark, monkeypatch):
    """F1."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", -1)
    known = decontamination.vocabulary(decontamination.windows(benchmark(spark)).select("terms").distinct())
    assert broadcasts(documents(spark).select("doc_id").join(decontamination.small(known.withColumn("doc_id", F.col("tid"))), "doc_id")) == 0
