"""Which rows near-dedup keeps where ids are null or repeated."""

from __future__ import annotations

from cases import documents

from lociworks.llm import simhash

A, B, C, D = (" ".join(f"{w}{k}" for k in range(80)) for w in ("harbour", "lantern", "meadow", "violin"))


def test_null_ids_are_documents_of_their_own(spark):
    docs = documents(spark, [(None, A), (None, B), (None, C), (None, C), (1, D)])
    assert sorted(r.text for r in simhash.keep_one(docs).collect()) == sorted([A, B, C, D])


def test_an_id_with_texts_in_two_components(spark):
    docs = documents(spark, [(7, A), (7, B), (3, B), (None, A), (9, C), (9, C)])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(7, A), (3, B), (9, C)])
