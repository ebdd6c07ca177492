"""Queries whose numbers stand for all rows ask for the neighbours of all."""

from __future__ import annotations

from lociworks.operators import neighbours
from lociworks.plans import registry

FOLDER = "/root/testdata/sf0.001"


def test_overlap_of_every_row(spark):
    """F4."""
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    found = registry.queries()["knn_overlap"](spark, FOLDER)
    assert found.select("q").distinct().count() == found.count() == e.count()
    assert "% 100" not in registry.oracle_sql()["knn_overlap"]


def test_a_record_of_every_row(spark, monkeypatch):
    """F5."""
    asked, real = [], neighbours.knn_join
    monkeypatch.setattr(neighbours, "knn_join", lambda queries, *more, **named: asked.append(queries.count()) or real(queries, *more, **named))
    assert registry.queries()["latent_record"](spark, FOLDER).count() == 1
    assert asked == [spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()] * 2
    assert "% 100" not in registry.oracle_sql()["latent_record"]
