"""Pairs of clusters that share no channel."""

from __future__ import annotations

import pytest

from lociworks.operators import spectra


def test_disjoint_clusters_are_pairs(spark):
    rows = [(0, "A[C>A]A", 3), (1, "A[C>A]C", 2), (2, "A[C>A]A", 1), (2, "A[C>A]C", 1)]
    counts = spark.createDataFrame(rows, "cluster_label int, channel string, n long")
    got = {(r.a, r.b): (r.cosine, r.l1, r.l2) for r in spectra.pairwise(counts).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    assert got[0, 1] == pytest.approx((0, 2, 2**0.5))
    assert got[0, 2] == pytest.approx((0.5**0.5, 1, 0.5**0.5))
