from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lociworks.functions import encode, filters, hashing, spectrum
from lociworks.operators import sampling
from lociworks.sources import catalogue, export, scan, shared


def test_hash_vectors():
    got = hashing.splitmix64(np.array([0, hashing.GAMMA, 2 * hashing.GAMMA % 2**64], dtype=np.uint64))
    assert [hex(x) for x in got] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4", "0x6c45d188009454f"]
    assert hashing.fnv1a64(b"") == 0xCBF29CE484222325
    assert hashing.fnv1a64(b"a") == 0xAF63DC4C8601EC8C


def test_threshold():
    assert hashing.threshold(0.1) == 1844674407370955161
    assert hashing.threshold(1 - 0.9) == hashing.threshold(0.1)
    for bad in (0, 1, -0.1):
        with pytest.raises(ValueError):
            hashing.threshold(bad)


def test_split_is_independent_of_order_and_nulls_have_values(spark):
    rows = [("chr1", i, "A", None if i % 3 else "C") for i in range(2000)]
    a = hashing.content_split(spark.createDataFrame(rows, "c string, p long, r string, a string"), ["c", "p", "r", "a"], 0.1, 5)
    b = hashing.content_split(spark.createDataFrame(rows[::-1], "c string, p long, r string, a string"), ["c", "p", "r", "a"], 0.1, 5)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert 140 < a.where("is_val").count() < 260
    nulls = hashing.mix(1, [pd.Series([None, ""], dtype=object)])
    assert nulls[0] == nulls[1]


@given(st.lists(st.integers(1, 10**6), min_size=1, max_size=12), st.integers(0, 5000))
def test_hamilton_adds_up(weights, seats):
    draw = sampling.hamilton(weights, seats)
    assert sum(draw) == seats
    assert all(abs(d - w * seats / sum(weights)) < 1 + 1e-6 for d, w in zip(draw, weights))


def test_hamilton_ties_and_refusals():
    assert sampling.hamilton([1, 1, 1], 4) == [2, 1, 1]
    for bad in ([], [0, 0], [1, -1]):
        with pytest.raises(ValueError):
            sampling.hamilton(bad, 3)


@given(st.lists(st.integers(1, 30), max_size=12), st.integers(0, 200))
def test_level_of_a_budget(sizes, budget):
    share = sampling.level([(n, 1) for n in sizes], budget)
    taken = lambda q: sum(min(n, q) for n in sizes)
    assert taken(share) <= budget and (taken(share + 1) > budget or share == max(sizes, default=0))


def test_budget_over_strata(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 3), ("b", 100), ("c", 100), (None, 50)) for i in range(n)], "k string, i int")
    count = lambda budget: {r.k: r["count"] for r in sampling.budget_sample(df, "k", ["i"], budget, 1).groupBy("k").count().collect()}
    assert count(43) == {"a": 3, "b": 20, "c": 20} and count(2) == {"a": 1, "b": 1} and count(0) == {} and sum(count(999).values()) == 203


@pytest.mark.parametrize("text", ["a = 1", "a >= 1 AND s <> 'x''y'", 'a IS NOT NULL and "s" IS NULL', "a<=-2.5"])
def test_filter_accepts(spark, text):
    df = spark.createDataFrame([(1, "x")], "a int, s string")
    df.where(filters.compile_filter(df, text)).collect()


@pytest.mark.parametrize("text", ["a = 1 OR a = 2", "(a = 1)", "a IN (1)", "abs(a) = 1", "a + 1 = 2", "missing = 1", "a = 1 AND", "", "a = s"])
def test_filter_refuses(spark, text):
    with pytest.raises(filters.RefusedFilter):
        filters.compile_filter(spark.createDataFrame([(1, "x")], "a int, s string"), text)


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = scan.scan(df, ["l_orderkey"], "l_quantity > 30")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,30.0)" in plan and "l_extendedprice" not in plan


def test_codes_and_scaling(spark):
    spec = encode.FeatureSpec("REF", "c", {"": 0, "A": 1})
    df = spark.createDataFrame([("A", 1.0), ("Z", float("nan")), (None, None)], "r string, x double")
    got = df.select(encode.category_code(F.col("r"), spec), encode.standardised(F.col("x"), 0.5, 0.25), encode.mask(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(1, 2.0, 1.0), (0, 0.0, 0.0), (0, 0.0, 0.0)]
    assert encode.FeatureSpec("x", "c", {str(i): i for i in range(16)}).width == 8
    assert encode.FeatureSpec("x", "c", {str(i): i for i in range(5)}).width == 6


def test_labels(spark):
    df = spark.createDataFrame([("C", "A", "T", "G"), ("G", "T", "T", "G"), ("N", "A", "C", "C"), ("A", "A", "C", "C"), (None, "A", "C", "C")], "r string, a string, p string, n string")
    c = F.col
    assert [r[0] for r in df.select(spectrum.canonical_label(c("r"), c("a"), c("p"), c("n"))).collect()] == ["T[C>A]G", "C[C>A]A", None, None, None]
    assert len(set(spectrum.channels())) == 96


def test_paths_and_names(spark, tmp_path):
    for n in ("b.x.parquet", "a.y.parquet"):
        (tmp_path / n).write_text("")
    assert [p.rsplit("/", 1)[1] for p in scan.resolve_paths(spark, [f"{tmp_path}/*.parquet", f"{tmp_path}/a*"])] == ["a.y.parquet", "b.x.parquet"]
    with pytest.raises(FileNotFoundError):
        scan.resolve_paths(spark, [f"{tmp_path}/none*"])
    df = spark.createDataFrame([("/d/s-1.featuremap.parquet", "1a-b.featuremap")], "f string, v string")
    assert tuple(df.select(scan.sample_id(F.col("f")), scan.view_name(F.col("v"))).first()) == ("s-1", "s_1a_b")


def test_row_numbers_survive_filters(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    df = scan.with_row_number(spark.read.parquet(f"{tmp_path}/t").where("id % 7 = 3"))
    assert all(r.id == r.file_row_number for r in df.collect())
    with pytest.raises(ValueError):
        scan.with_row_number(df)


def test_missing_columns_are_skipped(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "feature_a double, feature_b double")
    assert scan.scan(df, ["feature_a", "CHROM"]).columns == ["feature_a"]
    with pytest.raises(ValueError):
        scan.scan(df, ["CHROM"])


def test_fingerprints(spark, tmp_path):
    p, files = tmp_path / "x", shared.Files(spark)
    p.write_bytes(b"abc" * 9)
    record = shared.fingerprint(files, f"file:{p}", tail=4)
    assert record["size"] == 27 and record["tail_sha256"] == hashlib.sha256(b"cabc").hexdigest()
    record = shared.fingerprint(files, f"file:{p}")
    status = lambda r: shared.fingerprint_status(files, r, f"file:{p}")
    assert (status(record), status(None)) == ("OK", "NOFILE")
    p.touch()
    assert status(record) == "OK"
    p.write_bytes(b"abd" * 9)
    assert status(record) == "DRIFTED"
    p.write_bytes(b"abc")
    assert status(record) == "DRIFTED"
    p.unlink()
    assert status(record) == "MISSING"


def test_shared_files_are_whole(spark, tmp_path):
    files, path = shared.Files(spark), f"file:{tmp_path}/a/b"
    for data in (b"one", bytes(range(256)) * 40, b""):
        files.write(path, data)
        assert files.read(path) == data and [x[1] for x in files.stats(f"file:{tmp_path}")] == [len(data)]
    assert not files.exists(f"file:{tmp_path}/c")


def test_cells_of_any_form(spark, tmp_path):
    texts = {
        "a": '{"label": "a", "cell": {"fit_rows": 5}, "cohort_noise_fraction": 0.12345, "spectrum": {"top_channel_share_median": 0.98765}, "more": [1, {"x": 2}]}',
        "b": '{"label": "b", "error": "no memory"}',
        "c": '{"label": "c", "cell": {"fit',
        "d": '{"geometry": {"dbcv": -0.5}, "cohort_n_clusters": 3, "cluster_backend": "cpu"}',
        "e": "[1, 2]",
        "f": "",
    }
    for k, t in texts.items():
        (tmp_path / "cells" / k).mkdir(parents=True)
        (tmp_path / "cells" / k / "metrics.json").write_text(t)
    cells = catalogue.read_cells(spark, f"{tmp_path}/cells/*/metrics.json")
    assert {r.cell: r.status for r in cells.collect()} == {"a": "OK", "b": "ERROR", "c": "BROKEN", "d": "OK", "e": "BROKEN"}
    ranked = {r.cell: r for r in catalogue.ranked_cells(cells).collect()}
    assert (ranked["a"].fit_rows, ranked["a"].noise_pct, ranked["a"].backend, ranked["a"].top_chan, ranked["a"].dbcv) == (5, 12.35, "?", 0.988, None)
    assert (ranked["d"].n_clusters, ranked["d"].backend, ranked["d"].dbcv, ranked["d"].noise_pct) == (3, "cpu", -0.5, 0.0)
    planned = spark.createDataFrame([(c,) for c in "abfz"], "cell string")
    assert {r.cell: r.status for r in catalogue.completeness(planned, cells).collect()} == {"a": "OK", "b": "ERROR", "f": "INCOMPLETE", "z": "INCOMPLETE"}


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1234).repartition(3).write.parquet(f"{tmp_path}/t")
    df = catalogue.footer_count(spark, f"{tmp_path}/t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan and "ReadSchema: struct<count(*):bigint>" in plan
    assert df.first().n == 1234
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""  # the caller's session is left alone


def test_index_replaces_named_samples_only(spark, tmp_path):
    row = lambda s, n: (f"v_{s}", f"{s}.parquet", None, n, 1.5, "FILT = 1", s)
    put = lambda rows: catalogue.put_index(spark.createDataFrame(rows, catalogue.INDEX), f"{tmp_path}/index")
    put([row("a", 1), row("b", 2), row("c-1.x", 3)])
    put([row("b", 20)])
    put([row("b", 21), row("d", 4)])
    assert {r.sample: r.labelled_rows for r in catalogue.read_index(spark, f"{tmp_path}/index").collect()} == {"a": 1, "b": 21, "c-1.x": 3, "d": 4}


def test_percent_strings(spark):
    df = spark.createDataFrame([(" 12.5% ",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(export.percent(F.col("t"))).collect()] == [12.5, None, None]
