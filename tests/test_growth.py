"""What a search sends on and how often inputs are worked out, which decide how queries grow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociworks.functions.spectrum import canonical_label
from lociworks.operators import balls, neighbours, quality, spectra

from test_density import frame, slow_nearest


@pytest.mark.parametrize("offset", [0.0, 1e5])
def test_a_search_sends_each_query_to_few_cells(spark, monkeypatch, offset):
    """noise that no ball prunes; far from 0 the product of matrices alone would be wrong."""
    sent = []
    real = balls.checkpointed
    monkeypatch.setattr(balls, "checkpointed", lambda df: sent.append((df.columns, real(df))) or sent[-1][1])
    v = np.random.default_rng(1).normal(size=(1500, 8)) + offset
    v[700:720] = v[3]
    found = balls.nearest(frame(spark, v, "q"), balls.build(frame(spark, v), "id", "v"), 6)
    assert {(r.q, r.id, r.distance, r.place) for r in found.collect()} == slow_nearest(v, v, 6, False)
    routed = [df.count() for columns, df in sent if columns[0] == "q"]
    assert len(routed) == 1 and routed[0] <= 4 * len(v)


class Counted:
    """Tables that count how many of their rows are worked out."""

    def __init__(self, spark) -> None:
        self.n = spark.sparkContext.accumulator(0)

    def __call__(self, df):
        n = self.n

        def run(batches):
            for batch in batches:
                n.add(batch.num_rows)
                yield batch

        return df.mapInArrow(run, df.schema)


def test_inputs_are_worked_out_once_for_correlation(spark):
    """F2."""
    counted = Counted(spark)
    pairs = counted(spark.range(50).selectExpr("cast(id % 7 as double) as a", "cast(id * id % 11 as double) as b"))
    quality.pair_distance_correlation(pairs, "a", "b").collect()
    assert counted.n.value == 50


def test_neighbours_are_searched_once_for_overlap(spark):
    """F5."""
    counted = Counted(spark)
    near = spark.range(40).selectExpr("id div 4 as q", "id % 4 + 100 as id", "cast(id as double) as distance", "cast(id % 4 + 1 as int) as place")
    got = {r.overlap for r in neighbours.knn_overlap(counted(near), near, 4).collect()}
    assert got == {1.0} and counted.n.value == 40


def test_neighbours_are_searched_once_for_a_summary(spark):
    """F7."""
    counted = Counted(spark)
    one = neighbours.connectivity_summary(counted(spark.range(8).selectExpr("id as q", "id / 7 as same"))).first()
    assert one["median"] == pytest.approx(0.5) and counted.n.value == 8


def test_spectra_are_counted_once_and_by_bases(spark):
    """F8, F10."""
    counted = Counted(spark)
    kinds = ", ".join(f"substr('ACGT', cast(1 + pmod(xxhash64(id, {k}), 4) as int), 1) AS {c}" for k, c in zip((1, 3, 7, 11), spectra.BASES))
    rows = spark.sql(f"SELECT cast(id % 4 - 1 as int) AS cluster_label, {kinds} FROM range(400)")
    plain = rows.withColumn("channel", canonical_label(*map(F.col, spectra.BASES)))
    long = spectra.matrix_long(spectra.counts_by_bases(counted(rows), odd=F.count_if(F.col("REF") == "C")))
    got = {tuple(r) for r in long.where("n > 0").select("cluster_label", "channel", "n").collect()}
    assert got == {tuple(r) for r in spectra.spectrum_counts(plain).collect()} and len(got) > 3
    assert counted.n.value == 400
