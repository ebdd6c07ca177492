"""What is refused, and what must not depend on the rows that share a batch."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociworks.functions import hashing
from lociworks.operators import balls, histograms, joins, latent, neighbours, quality, ranks, reports, sampling
from lociworks.sources import export


def test_large_keys_and_nulls_in_one_batch(spark):
    big = [(2**53 + 1 + 2 * k,) for k in range(4000)]
    split = lambda rows: {r.k: r.is_val for r in hashing.content_split(spark.createDataFrame(rows, "k long").coalesce(1), ["k"], 0.25, 7).collect()}
    alone, with_null = split(big), split([*big, (None,)])
    assert {k: v for k, v in with_null.items() if k is not None} == alone
    assert 800 < sum(alone.values()) < 1200
    zero = split([(None,), (0,)])
    assert zero[None] == zero[0]


def test_a_starving_group_is_refused(spark):
    df = spark.range(1001).withColumn("s", F.when(F.col("id") < 1000, "big").otherwise("tiny"))
    with pytest.raises(Exception, match="draws no row of tiny"):
        sampling.interleaved(df, "s", ["id"], 16, 3).collect()
    draws = sampling.apportion(df.groupBy("s").agg(F.count("*").alias("n")), "s", "n", 16)
    assert tuple(sampling.starving(draws, 16).first()) == (2, 1, False, True)
    fed = sampling.interleaved(df.withColumn("s", F.when(F.col("id") % 3 > 0, "big")), "s", ["id"], 16, 3, bins=8)
    assert fed.count() == 1001 and fed.where("batch_id IS NULL").count() == 0


def test_nans_are_in_no_bin(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", float("nan")), ("a", float("inf")), ("a", None), ("a", -9.0)], "g string, x double")
    assert {(r.bin, r.n) for r in histograms.histogram(df, ["g"], "x", 0.0, 1.0, 4).collect()} == {(2, 1), (0, 1)}


def test_variances_of_large_means(spark):
    x = np.random.default_rng(1).normal(1e7, 3, (3000, 2))
    df = spark.createDataFrame([(int(v[0] > 1e7), v.tolist()) for v in x], "k int, v array<double>")
    got = {r.dim: r.variance for r in latent.activation(df, "v", 2).collect()}
    assert got[0] == pytest.approx(x[:, 0].var(), rel=1e-6) and got[1] == pytest.approx(x[:, 1].var(), rel=1e-6)
    m = latent.cross_moments(df, latent.columns_of("v", 1), [F.col("v")[1]])
    assert m["ab"][0, 0] / m["n"] == pytest.approx(np.cov(x.T, bias=True)[0, 1], rel=1e-4)
    k = x[:, 0] > 1e7
    parts = [x[k], x[~k]]
    within = sum(((p - p.mean(0)) ** 2).sum() for p in parts)
    between = sum(len(p) * ((p.mean(0) - x.mean(0)) ** 2).sum() for p in parts)
    assert quality.calinski_harabasz(df, "k", latent.columns_of("v", 2)).first()[0] == pytest.approx(between * (len(x) - 2) / within, rel=1e-6)


def test_exact_quantiles_and_ranks(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", None) for v in rng.integers(0, 30, 401)] + [("b", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r for r in ranks.quantiles(df, ["g"], "x", {"lo": 0.1, "mid": 0.5, "hi": 0.93}).collect()}
    assert set(got) == {"a", None, "b"}
    for g, r in got.items():
        own = [v for h, v in rows if h == g]
        assert (r.n, r.lo, r.mid, r.hi) == (len(own), *(pytest.approx(q) for q in np.quantile(own, [0.1, 0.5, 0.93])))
    whole = {r.x: r.before for r in ranks.value_ranks(df, [], "x").collect()}
    values = sorted(v for _, v in rows if v is not None)
    assert whole == {v: values.index(v) for v in set(values)}


def test_exact_ranks_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(balls, "WAVE", 2)
    x = np.random.default_rng(5).integers(0, 6, (50, 2)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    pairs = [(0, 7), (0, 3), (10, 11), (20, 49), (20, 1), (20, 2)]
    got = {(r.q, r.id): r["rank"] for r in neighbours.ranks_among_all(spark.createDataFrame(pairs, "q long, id long"), df).collect()}
    for q, i in pairs:
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 6)
        order = sorted((d[k], k) for k in range(50) if k != q)
        assert got[q, i] == order.index((d[i], i)) + 1


def test_positions_must_match(spark):
    with pytest.raises(ValueError):
        joins.positional(spark.range(3).toDF("n"), "n", spark.range(2).toDF("at"), "at")
    with pytest.raises(ValueError):
        sampling.clamped(5, 0)
    assert (sampling.clamped(None, 9), sampling.clamped(5, 9), sampling.clamped(50, 9)) == (9, 5, 9)


def test_permutation_split_is_clipped(spark):
    for fraction, held in ((0.0, 1), (1.0, 9), (0.35, 3)):
        assert sampling.permutation_split(spark.range(10), ["id"], fraction, 1).where("is_val").count() == held


def test_six_digits(spark):
    values = [0.0, 1.0, 30.123456789, 1e-5, 123456789.0, 0.00012345678, -2.5, 1e20, 100000.0, 1000000.0, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(export.six_digits(F.col("x"))).collect()]
    assert got == [None if v is None or v != v else "%.6g" % v for v in values]


def test_chance_information_and_silhouette(spark):
    import math

    def chance(sizes_a, sizes_b):
        n, total = sum(sizes_a), 0.0
        for a in sizes_a:
            for b in sizes_b:
                for m in range(max(1, a + b - n), min(a, b) + 1):
                    total += m / n * math.log(n * m / (a * b)) * math.comb(a, m) * math.comb(n - a, b - m) / math.comb(n, b)
        return total

    rows = [(a, b, (a + 2 * b) % 5 + 1) for a in range(3) for b in range(4)]
    got = reports.adjusted_information(spark.createDataFrame(rows, "a int, b int, n long")).first()
    sizes = [[sum(n for r in rows if r[k] == v for n in [r[2]]) for v in range(size)] for k, size in ((0, 3), (1, 4))]
    assert got.expected == pytest.approx(chance(*sizes), rel=1e-10)
    same = spark.createDataFrame([(0, 0, 5), (1, 1, 7)], "a int, b int, n long")
    assert reports.adjusted_information(same).first().ami == pytest.approx(1)
    points = [([0.0, 0.0], 0), ([0.0, 1.0], 0), ([5.0, 5.0], 1), ([5.0, 6.0], 1), ([9.0, 9.0], 2)]
    d = lambda p, q: math.dist(p[0], q[0])
    want = []
    for p in points:
        means = {k: [d(p, q) for q in points if q[1] == k and q is not p] for k in range(3)}
        inner, outer = means.pop(p[1]), min(sum(v) / len(v) for k, v in means.items() if k != p[1])
        want.append(0.0 if not inner else (outer - sum(inner) / len(inner)) / max(outer, sum(inner) / len(inner)))
    one = reports.silhouette(spark.createDataFrame(points, "v array<double>, k int"), "v", "k").first()
    assert (one.n, one.silhouette) == (5, pytest.approx(sum(want) / 5))
