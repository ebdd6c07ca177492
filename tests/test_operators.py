from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociworks.functions.encode import FeatureSpec
from lociworks.operators import balls, dedup, latent, models, moments, neighbours, sampling
from lociworks.sources import export
from lociworks.streaming import spectrum_stream
from lociworks.streaming.spectrum_stream import early_stop


def test_dedup_without_identity_columns_keeps_all(spark):
    df = spark.createDataFrame([(1,), (2,), (1,)], "feature_a int")
    assert dedup.ranked_dedup(df, ["QUAL"]).count() == 3


def test_dedup_counts_null_keys(spark):
    df = spark.createDataFrame([("c", 1, None, "A", 1.0), ("c", 1, None, "A", None), ("c", 2, "G", "A", 3.0)], "CHROM string, POS int, REF string, ALT string, QUAL double")
    got = {(r.POS, r.QUAL): r.locus_reads for r in dedup.ranked_dedup(df, ["QUAL"]).collect()}
    assert got == {(1, 1.0): 2, (2, 3.0): 1}


def test_moments_merge_like_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", float(x)) for k, n in enumerate((5, 1000, 37, 2, 900)) for x in rng.normal(1e7, 3, n)]
    parts = moments.fused_moments(spark.createDataFrame(rows, "sample string, x double"), "sample", ["x"])
    got = moments.merge_moments(parts, "sample").first()
    x = np.array([v for _, v in rows])
    assert got.n == len(x)
    assert got["mean"] == pytest.approx(x.mean(), rel=1e-12)
    assert got.m2 / (got.n - 1) == pytest.approx(x.var(ddof=1), rel=1e-9)


def test_constant_and_null_columns(spark):
    df = spark.createDataFrame([("a", 7.0, None), ("a", 7.0, None)], "s string, c double, e double")
    got = moments.standard_scale(moments.merge_moments(moments.fused_moments(df, "s", ["c", "e"]), "s")).collect()
    assert [(r.feature, r.n, r["std"]) for r in got] == [("c", 2, 1.0)]


def test_moment_cache(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("double").alias("x")).coalesce(1).write.parquet(f"{tmp_path}/p")
    cache = moments.MomentCache(spark, f"file:{tmp_path}/cache")
    run = lambda where: moments.file_moments(spark, [f"{tmp_path}/p"], where, ["x"], cache)
    one, two = run("x >= 0"), run("x >= 0")
    assert [r.cached for r in one.collect()] == [False] and [r.cached for r in two.collect()] == [True]
    assert one.drop("cached").collect() == two.drop("cached").collect()
    key = cache.key(f"{tmp_path}/p", "x >= 0", ["x"])
    (tmp_path / "cache" / f"{key}.json").write_text("{")  # what is no JSON is worked out again
    (tmp_path / "cache" / f".{key}.json.crc").unlink()
    assert cache.get(key) is None and [r.cached for r in run("x >= 0").collect()] == [False]
    spark.range(5).select(F.col("id").cast("double").alias("x")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    assert [(r.cached, r.n) for r in run("x >= 0").collect()] == [(False, 15)]
    with pytest.raises(ValueError):
        run("x > 99")


def test_interleaving_covers_every_row_in_proportion(spark):
    df = spark.range(1200).withColumn("s", F.when(F.col("id") < 900, "big").otherwise("small"))
    got = sampling.interleaved(df, "s", ["id"], 64, 3)
    assert got.count() == 1200 and got.select("id").distinct().count() == 1200
    first = got.where("batch_id = 0").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in first} == {"big": 48, "small": 16}


def test_shards_are_disjoint_and_cover(spark):
    groups = spark.range(37).withColumn("s", F.lit("a"))
    shards = [{r.id for r in sampling.epoch_shard(groups, "s", "id", e, 4, 1).collect()} for e in range(4)]
    assert sum(map(len, shards)) == 37 and set().union(*shards) == set(range(37))


def test_nested_samples_are_nested(spark):
    rows = sampling.nested_samples(spark.range(500), ["id"], [10, 40, 90], 2).collect()
    by = {n: {r.id for r in rows if r.size == n} for n in (10, 40, 90)}
    assert [len(by[n]) for n in (10, 40, 90)] == [10, 40, 90]
    assert by[10] < by[40] < by[90]


def test_neighbours_with_duplicates(spark, monkeypatch):
    monkeypatch.setattr(balls, "WAVE", 3)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3)).astype(np.float32)
    x[10] = x[20]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.knn_join(df.where("vec_id % 10 = 0"), df, 4).collect()
    for q in range(0, 60, 10):
        d = np.round(np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1)), 6)
        want = sorted((d[i], i) for i in range(60) if i != q)[:4]
        assert sorted((r.distance, r.id) for r in got if r.q == q) == want
    assert neighbours.knn_join(df.where("vec_id < 0"), df, 4).count() == 0


def test_likeness_of_equal_tables(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(v.tolist(),) for v in rng.normal(size=(50, 4))], "embedding array<double>")
    x = latent.columns_of("embedding", 4)
    m = latent.cross_moments(df, x, [-c for c in x])
    assert latent.linear_cka(m) == pytest.approx(1)
    assert latent.procrustes(m) == pytest.approx(0, abs=1e-9)
    assert latent.gram_likeness(m) == pytest.approx(1, abs=1e-6)


def test_layers_equal_numpy(spark):
    layers = models.Layers.fixed([3, 5, 2], 1)
    x = np.arange(12.0).reshape(4, 3)
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (9, None)], "k long, v array<double>")
    got = {r.k: r.latent for r in models.apply_layers(df, layers, "k", "v").collect()}
    assert got.pop(9) is None
    for i in range(4):
        assert np.allclose(got[i], layers(x[i : i + 1])[0], rtol=1e-5)


def slow_non_negative(s: np.ndarray, x: np.ndarray) -> float:
    """The least residual over all sets of signatures whose unconstrained solution isn't negative."""
    best, k = np.linalg.norm(x), s.shape[1]
    for held in itertools.product([False, True], repeat=k):
        own = s[:, list(held)]
        h = np.linalg.lstsq(own, x, rcond=None)[0] if own.size else np.zeros(0)
        if (h >= 0).all():
            best = min(best, np.linalg.norm(own @ h - x))
    return best


def test_least_squares_are_optimal():
    rng = np.random.default_rng(5)
    for k in (0, 1, 2, 3, 5, 6) * 8:
        s, x = rng.random((12, k)) ** 3, rng.random(12) * rng.integers(0, 2)
        if k > 2:
            s[:, 1] = s[:, 0] * 2  # one depends on another
        h = models.non_negative(s.T @ s, s.T @ x)
        assert (h >= 0).all() and np.linalg.norm(s @ h - x) == pytest.approx(slow_non_negative(s, x), abs=1e-9)
        assert k == 0 or (s.T @ (x - s @ h)).max() <= 1e-8


def test_signatures_are_recovered(spark):
    s = np.random.default_rng(5).dirichlet(np.ones(20), 3).T
    x = s @ np.array([100.0, 0.0, 50.0])
    known = spark.createDataFrame([(f"c{i}", *map(float, r)) for i, r in enumerate(s)], "Type string, a double, b double, c double")
    rows = [(1, f"c{i}", float(v)) for i, v in enumerate(x)] + [(2, "c0", None), (3, "other", 4.0), (None, "c1", 2.0)]
    got = {r.k: r for r in models.signature_fit(spark.createDataFrame(rows, "k int, Type string, n double"), "k", "Type", "n", known).collect()}
    assert np.allclose([got[1].activities[c] for c in "abc"], [100, 0, 50]) and got[1].cosine == pytest.approx(1) and got[1].l2 < 1e-9
    for k in (2, 3):
        assert set(got[k].activities.values()) == {0.0} and got[k].cosine == 0
    assert got[3].l1 == 4 and got[None].total == 2 and all(r.gradient <= 1e-9 for r in got.values())
    assert models.signature_fit(spark.createDataFrame([], "k int, Type string, n double"), "k", "Type", "n", known).count() == 0


def test_mixed_encoder(spark):
    rng = np.random.default_rng(2)
    spec = [FeatureSpec("REF", "c", {"": 0, "A": 1, "C": 2}), FeatureSpec("kind", "c", {"x": 0, "y": 1})]
    made = models.MixedEncoder({"REF": rng.normal(size=(3, 2)), "kind": rng.normal(size=(2, 3))}, models.Layers([rng.normal(size=(6, 4)), rng.normal(size=(4, 2))], [rng.normal(size=4), rng.normal(size=2)]))
    stored = models.weights_table(spark, made)
    rows = [(1, "A", "y", 3.0), (2, "Z", None, None), (3, None, "x", float("nan")), (4, "C", "q", -1.0)]
    df = spark.createDataFrame(rows, "k int, REF string, kind string, q double")
    got = {r.k: r.latent for r in models.encode_mixed(df, ["k"], spec, {"q": (1.0, 2.0)}, stored).collect()}
    want = made(np.array([[1, 1], [0, 0], [0, 0], [2, 0]]), np.array([[1.0], [0.0], [0.0], [-1.0]]))
    assert all(np.allclose(got[k], want[k - 1]) for k in got) and len(got) == 4
    assert models.encode_mixed(df.where("false"), ["k"], spec, {"q": (1.0, 2.0)}, stored).count() == 0
    with pytest.raises(ValueError):
        models.encode_mixed(df, ["k"], [*spec, FeatureSpec("more", "c", {"": 0})], {}, stored)
    with pytest.raises(ValueError):
        models.encode_mixed(df, ["k"], [FeatureSpec("REF", "c", {"": 0, "G": 3})], {}, stored)


def test_early_stopping(spark):
    losses = [1.0, 0.5, 0.5, 0.5, 0.4]
    rows = [(list(zip(range(5), losses, [4, 4, 4, 4, 4])),)]
    df = spark.createDataFrame(rows, "e array<struct<epoch: long, loss: double, active: long>>")
    assert df.select(early_stop(F.col("e"), 1e-3, 2).alias("s")).select("s.stopped_at", "s.best").first() == (3, 0.5)


def test_vcf(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 5, "A", "C", 30.123456789, 1, -1, 0.25)], "CHROM string, POS int, REF string, ALT string, QUAL double, FILT int, cluster_label int, umap_1 double")
    assert export.vcf_lines(df).first().line == "chr1\t5\t.\tA\tC\t30.1235\tPASS\tCLUSTER=-1;UMAP1=0.25;SRC_FILT=1"
    export.write_vcf(df, f"{tmp_path}/v", export.vcf_header("20240101", "test"))
    assert spark.read.text(f"{tmp_path}/v/header").first()[0].startswith("##fileformat=VCFv4.3")
    with pytest.raises(ValueError):
        export.write_vcf(df.where("POS < 0"), f"{tmp_path}/w", [])


def test_concatenation_reconciles(spark, tmp_path):
    assert export.concatenate({"a": spark.range(3).toDF("x"), "b": spark.range(4).toDF("y")}, f"{tmp_path}/c") == 7


def sides(k: int, n: int, label: int) -> list[tuple]:
    return [("C", "A", "T", "G", label)] * n + [("G", "T", "C", "A", label)] * k + [("C", "A", "T", "G", -1)]


def test_spectrum_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    schema = "REF string, ALT string, X_PREV1 string, X_NEXT1 string, cluster_label int"
    source, out, state = (f"{tmp_path}/{x}" for x in ("in", "out", "state"))
    run = lambda: spectrum_stream.stream_spectrum(spark.readStream.schema(schema).parquet(source), out, state)
    spark.createDataFrame(sides(0, 3, 0), schema).coalesce(1).write.parquet(source)
    run().awaitTermination()
    spark.createDataFrame(sides(1, 2, 0) + sides(0, 4, 1), schema).coalesce(1).write.mode("append").parquet(source)
    start = spectrum_stream.into_batches

    def failing(changed, path, checkpoint):
        def put(batch, number):
            batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
            raise RuntimeError("lost after writing")

        return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    monkeypatch.setattr(spectrum_stream, "into_batches", failing)
    with pytest.raises(Exception, match="lost after writing"):
        run().awaitTermination()
    monkeypatch.setattr(spectrum_stream, "into_batches", start)
    run().awaitTermination()  # the same batch again
    run().awaitTermination()  # and nothing new
    got = spectrum_stream.latest(spark, out, ["cluster_label", "channel"]).collect()
    assert {(r.cluster_label, r.channel): r.n for r in got} == {(0, "T[C>A]G"): 6, (1, "T[C>A]G"): 4}


def test_early_stopping_of_a_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(k, e, round(float(1 / (1 + e) + rng.normal(0, 0.05)), 3), 4 + (e % 7 == 0)) for k in ("a", "b", "c") for e in range(20)] + [("d", 0, None, 1), ("d", None, 1.0, 1)]
    schema, source = "run string, epoch long, loss double, active long", f"{tmp_path}/in"
    for part in (0, 1, 2):
        own = [r for r in rows if (r[1] or 0) // 7 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        spectrum_stream.stream_early_stop(stream, "run", 1e-3, 3, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {r.run: (r.best, r.stagnant, r.stopped_at) for r in spectrum_stream.latest(spark, f"{tmp_path}/out", ["run"]).collect()}
    assert got.pop("d") == (None, 0, None)
    df = spark.createDataFrame(rows, schema).where("loss IS NOT NULL AND epoch IS NOT NULL").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("epoch", "loss", "active"))).alias("e"))
    assert got == {r.run: (r.s.best, r.s.stagnant, r.s.stopped_at) for r in df.select("run", early_stop(F.col("e"), 1e-3, 3).alias("s")).collect()}
