"""The language model's filter holds all tokens and pairs, in one piece or in several."""

from __future__ import annotations

import numpy as np
import pytest
from cases import documents, texts
from pyspark.sql import functions as F

from lociworks.llm import lm


@pytest.mark.parametrize("pieces", [1, 8])
def test_every_pair_is_in_the_filter(spark, monkeypatch, pieces):
    docs = documents(spark)
    want = None
    if pieces > 1:
        whole, counts = lm.train(docs, F.lit(True))
        want = sorted((r.doc_id or -1, r.score) for r in lm.score(docs, whole, counts).collect())
        monkeypatch.setattr(lm, "PIECE_BITS", whole.counts.chunks * whole.counts.chunk_bits // pieces)
        monkeypatch.setattr(lm, "HELD_BITS", 0)
    model, counts = lm.train(docs, F.lit(True))
    toks, sizes = lm.tokens([t for _, t in texts()])
    for grams in (toks, lm.pairs(lm.preceding(toks, sizes), toks)):
        kinds, n = np.unique(grams, return_counts=True)
        assert (n == 1).any() and (model.counts.count(kinds) >= n / 2).all()
    if want:
        assert len(model.counts.pieces) == pieces
        assert np.allclose(sorted((r.doc_id or -1, r.score) for r in lm.score(docs, model, counts).collect()), want)


def test_size_follows_the_items(spark):
    few = spark.range(1000).select(F.xxhash64("id").alias("h"), F.lit(1).cast("long").alias("n"))
    sizes = [f.chunks * f.chunk_bits for f in (lm.build_filter(few, items) for items in (1000, 1 << 25))]
    assert sizes[1] >= (1 << 25) * lm.BITS_PER_ITEM


def test_parts_follow_the_number_of_grams(spark, monkeypatch):
    assert [lm.parts_for(n) for n in (0, 1, lm.PARTS * lm.PART_GRAMS, lm.PARTS * lm.PART_GRAMS + 1)] == [lm.PARTS, lm.PARTS, lm.PARTS, 2 * lm.PARTS]
    grams = spark.createDataFrame([(int(h), int(n)) for h, n in zip(lm.mixed(np.arange(5000, dtype=np.uint64)).view(np.int64), [1, 3, 70] * 1667)], "h long, n long")
    monkeypatch.setattr(lm, "SMALL_BITS", 1 << 10)
    items = int(lm.levels(np.array([r.n for r in grams.collect()])).sum())
    h = lm.mixed(np.arange(5000, dtype=np.uint64))
    few, many = (lm.filter_of(lm.merged(lm.packed(grams, dealt)), items, dealt).count(h) for dealt in (16, 64))
    assert (few > 0).all() and (many > 0).all() and (few[:3] == many[:3]).all()
