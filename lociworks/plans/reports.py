"""Joined exports, reports over labelings, spectra and sweeps, sample designs, and models given as tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import spectrum
from ..operators import compare, histograms, joins, models, neighbours, reports, sampling, spectra
from ..sources import scan
from ..sources.checkpoint import checkpointed
from ..sources.featuremap import CANONICAL, FM_SQL, featuremap
from .named import named
from .relational import _AGREE, _CONT, _L, _SPEC, _TOP, contingency, spectrum_of, spectrum_pairwise, spectrum_top_channel

_W = f"WITH {FM_SQL}"
_O = "md5('{0}|' || CAST(o_orderkey AS VARCHAR))"


def _table(spark, sf_dir, name):
    return scan.table(spark, sf_dir, name)


# joined exports


@named("SELECT p_size % 9 - 1 AS cluster_label, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10 AND p_size % 9 - 1 >= 0 GROUP BY 1")
def label_counts(spark, sf_dir):
    """Labels of parts joined to source rows that pass a filter; noise goes after the join."""
    source = _table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "key")
    labels = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 9 - 1).alias("cluster_label"))
    return joins.label_counts(source, labels, ["key"], "cluster_label", F.col("l_quantity") > 10, F.col("cluster_label") >= 0)


@named(f"{_SPEC}, z AS (SELECT cluster_label, count(*) AS size FROM fm WHERE cluster_label < 9 GROUP BY 1) SELECT cluster_label, channel, n, size, round(n / size, 8) AS fraction FROM spec LEFT JOIN z USING (cluster_label)")
def channel_fractions(spark, sf_dir):
    """Counts beside cluster sizes, of which some are missing."""
    sizes = featuremap(spark, sf_dir).where("cluster_label < 9").groupBy("cluster_label").agg(F.count("*").alias("size"))
    return spectrum_of(spark, sf_dir).join(sizes, "cluster_label", "left").withColumn("fraction", F.round(F.col("n") / F.col("size"), 8))


@named(
    f"""{_W}, s AS (SELECT cluster_label, sample AS sample_name, count(*) AS n FROM fm WHERE cluster_label >= 0 GROUP BY 1, 2), a AS (SELECT cluster_label, round(avg(SNVQ), 4) AS activity FROM fm WHERE cluster_label < 8 GROUP BY 1),
f AS (SELECT cluster_label, sample AS sample_name, max(QUAL) AS fit FROM fm WHERE sample <> 'A' GROUP BY 1, 2) SELECT * FROM s LEFT JOIN a USING (cluster_label) LEFT JOIN f USING (cluster_label, sample_name)"""
)
def cluster_statistics(spark, sf_dir):
    fm = featuremap(spark, sf_dir).withColumnRenamed("sample", "sample_name")
    stats = fm.where("cluster_label >= 0").groupBy("cluster_label", "sample_name").agg(F.count("*").alias("n"))
    activities = fm.where("cluster_label < 8").groupBy("cluster_label").agg(F.round(F.avg("SNVQ"), 4).alias("activity"))
    fits = fm.where("sample_name <> 'A'").groupBy("cluster_label", "sample_name").agg(F.max("QUAL").alias("fit"))
    return joins.with_stats(stats, activities, fits, "cluster_label", "sample_name")


@named("WITH e AS (SELECT o_custkey AS id, row_number() OVER (ORDER BY o_custkey) - 1 AS position FROM (SELECT DISTINCT o_custkey FROM orders)), w AS (SELECT DISTINCT l_suppkey * 3 AS id FROM lineitem) SELECT id, position FROM w LEFT JOIN e USING (id)")
def id_subset(spark, sf_dir):
    """Where wanted ids stand among all sorted ones; misses have no position."""
    ids = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return joins.subset_positions(ids, _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 3).alias("id")), "id")


@named(
    """WITH f AS (SELECT 's' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.fm' ELSE '' END AS file FROM nation), d AS (SELECT 's' || n_nationkey || CASE WHEN n_nationkey % 4 = 0 THEN '.fm' ELSE '' END AS folder FROM nation WHERE n_nationkey % 5 > 0)
SELECT file, coalesce((SELECT folder FROM d WHERE folder = file), (SELECT folder FROM d WHERE folder = regexp_replace(file, '[.]fm$', ''))) AS folder FROM f"""
)
def file_match(spark, sf_dir):
    n = F.col("n_nationkey")
    name = lambda k: F.concat(F.lit("s"), n.cast("string"), F.when(n % k == 0, ".fm").otherwise(""))
    nation = _table(spark, sf_dir, "nation")
    return joins.match_names(nation.select(name(2).alias("file")), "file", nation.where(n % 5 > 0).select(name(4).alias("folder")), "folder", "[.]fm")


# orders of reports


@named(f"{_W} SELECT row_number() OVER (ORDER BY CHROM NULLS LAST, POS NULLS LAST, REF NULLS LAST, ALT NULLS LAST, MAPQ NULLS LAST, okey NULLS LAST, DP NULLS LAST) - 1 AS row_index, CHROM, POS, REF, ALT, MAPQ, okey, DP FROM fm WHERE {CANONICAL}")
def stable_order(spark, sf_dir):
    """Rows numbered by all their columns, nulls last."""
    columns = ["CHROM", "POS", "REF", "ALT", "MAPQ", "okey", "DP"]
    own = featuremap(spark, sf_dir).where(CANONICAL).select(*columns, F.col("MAPQ").isNull().alias("_last"))
    order = ["CHROM", "POS", "REF", "ALT", "_last", "MAPQ", "okey", "DP"]
    return joins.dense_index(own, order).select("row_index", *columns)


_CELLS = "cells AS (SELECT o_orderpriority AS cell, o_orderstatus AS kind, avg(o_totalprice) AS score, count(*) AS size, max(o_orderkey) % 3 = 0 AS failed FROM orders GROUP BY 1, 2)"


def _cells(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("cell"), F.col("o_orderstatus").alias("kind")).agg(F.avg("o_totalprice").alias("score"), F.count("*").alias("size"), (F.max("o_orderkey") % 3 == 0).alias("failed"))


@named(f"WITH {_CELLS} SELECT cell, kind, round(score, 4) AS score, size, row_number() OVER (ORDER BY size DESC, cell, kind) AS place FROM cells")
def ranking_table(spark, sf_dir):
    cells = reports.ranking(_cells(spark, sf_dir), [F.desc("size"), F.col("cell"), F.col("kind")])
    return cells.select("cell", "kind", F.round("score", 4).alias("score"), "size", "place")


@named(f"WITH {_CELLS} SELECT cell, kind, size FROM cells WHERE NOT failed ORDER BY score DESC, cell, kind LIMIT 1")
def best_cell(spark, sf_dir):
    return reports.best_cell(_cells(spark, sf_dir), "score", F.col("failed"), ["cell", "kind"]).select("cell", "kind", "size")


@named("SELECT s_suppkey, concat_ws('_', 'nn' || s_suppkey % 3 * 5, CASE WHEN s_suppkey % 2 <> 0 THEN 'md' || s_suppkey % 2 END, CASE WHEN s_suppkey % 5 <> 4 THEN 'nc' || s_suppkey % 5 END) AS label FROM supplier")
def config_labels(spark, sf_dir):
    k = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", reports.config_label([("nn", k % 3 * 5, None), ("md", k % 2, 0), ("nc", k % 5, 4)]).alias("label"))


@named("SELECT l_returnflag AS g, count(*) AS n, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS exponent, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 3) AS factor, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1")
def power_law(spark, sf_dir):
    out = reports.power_law(_table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_extendedprice", ["g"])
    return out.select("g", "n", F.round("exponent", 6).alias("exponent"), F.round("factor", 3).alias("factor"), F.round("r2", 6).alias("r2"))


@named(
    """WITH v AS (SELECT l_returnflag AS g, CAST(l_linenumber AS DOUBLE) AS size, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2), lo AS (SELECT * FROM v WHERE size <= 2.5 QUALIFY row_number() OVER (PARTITION BY g ORDER BY size DESC) = 1), hi AS (SELECT * FROM v WHERE size >= 2.5 QUALIFY row_number() OVER (PARTITION BY g ORDER BY size) = 1)
SELECT g, round(exp(ln(lo.cost) + (ln(2.5) - ln(lo.size)) / (ln(hi.size) - ln(lo.size)) * (ln(hi.cost) - ln(lo.cost))), 2) AS value FROM lo JOIN hi USING (g)"""
)
def log_interpolation(spark, sf_dir):
    v = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").cast("double").alias("size")).agg(F.sum("l_extendedprice").alias("cost"))
    return reports.log_interpolate(v, "size", "cost", F.lit(2.5), ["g"]).withColumn("value", F.round("value", 2))


# labelings and spectra

_INNER = _AGREE.replace("t AS (SELECT cluster_label AS a, other_label AS b, count(*) AS n FROM fm GROUP BY ALL)", "t AS (SELECT cluster_label AS a, other_label AS b, count(*) AS n FROM fm WHERE cluster_label >= 0 AND other_label >= 0 GROUP BY ALL)")
_SCORES = "round((both_in - in_a * in_b / (n * (n - 1) / 2)) / ((in_a + in_b) / 2 - in_a * in_b / (n * (n - 1) / 2)), 8) AS ari, round(2 * mi / (h_a + h_b), 8) AS nmi, round(greatest(h_a - mi, 0) + greatest(h_b - mi, 0), 8) AS vi, round(most / n, 8) AS purity"


@named(
    f"""WITH w AS ({_AGREE} SELECT {_SCORES} FROM s), i AS ({_INNER} SELECT {_SCORES} FROM s),
c AS ({_CONT} SELECT CAST(sum(n) AS BIGINT) AS rows, count(DISTINCT a) FILTER (a >= 0) AS clusters_a, count(DISTINCT b) FILTER (b >= 0) AS clusters_b, round(sum(n) FILTER (a >= 0 AND b >= 0) / sum(n), 8) AS both_clustered,
  CAST(coalesce(sum(n) FILTER (a < 0 AND b < 0), 0) AS BIGINT) AS noise_both, CAST(coalesce(sum(n) FILTER (a < 0 AND b >= 0), 0) AS BIGINT) AS noise_a_only, CAST(coalesce(sum(n) FILTER (a >= 0 AND b < 0), 0) AS BIGINT) AS noise_b_only FROM t)
SELECT c.*, w.*, i.ari AS ari_clustered, i.nmi AS nmi_clustered, i.vi AS vi_clustered, i.purity AS purity_clustered FROM c, w, i"""
)
def labeling_record(spark, sf_dir):
    r = reports.labeling_record(checkpointed(contingency(spark, sf_dir)))
    return r.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


@named(
    f"""{_AGREE}, e AS (SELECT sum(m / tot.n * ln(tot.n * m / (CAST(ma.n AS DOUBLE) * mb.n)) * exp(lgamma(ma.n + 1.0) + lgamma(mb.n + 1.0) + lgamma(tot.n - ma.n + 1.0) + lgamma(tot.n - mb.n + 1.0) - lgamma(tot.n + 1.0) - lgamma(m + 1.0) - lgamma(ma.n - m + 1.0)
  - lgamma(mb.n - m + 1.0) - lgamma(tot.n - ma.n - mb.n + m + 1.0))) AS expected FROM ma, mb, tot, range(1, 1000000) r(m) WHERE m BETWEEN greatest(1, ma.n + mb.n - tot.n) AND least(ma.n, mb.n))
SELECT round((mi - expected) / ((h_a + h_b) / 2 - expected), 7) AS ami, round(expected, 7) AS expected FROM s, e"""
)
def ami(spark, sf_dir):
    out = reports.adjusted_information(checkpointed(contingency(spark, sf_dir)))
    return out.select(F.round("ami", 7).alias("ami"), F.round("expected", 7).alias("expected"))


@named(
    f"""{_TOP}, p AS (SELECT cluster_label, channel AS top_channel, round(n / total, 6) AS share FROM r WHERE place = 1), b AS (SELECT top_channel, count(*) AS n FROM p GROUP BY 1),
l AS (SELECT string_agg(top_channel || ':' || n, ',' ORDER BY n DESC, top_channel) AS top_three FROM (SELECT * FROM b ORDER BY n DESC, top_channel LIMIT 3))
SELECT count(*) AS clusters, round(avg(share), 6) AS mean, count(DISTINCT top_channel) AS dominants, avg(CAST(share > 0.5 AS INT)) AS over_50, avg(CAST(share > 0.8 AS INT)) AS over_80, round(median(share), 6) AS median, any_value(top_three) AS top_three, round(count(*) / count(DISTINCT top_channel), 6) AS clusters_per_dominant FROM p, l"""
)
def spectrum_concentration(spark, sf_dir):
    c = reports.concentration_summary(checkpointed(spectrum_top_channel(spark, sf_dir)))
    return c.select(*[F.round(x, 6).alias(x) if x in ("mean", "median", "clusters_per_dominant") else F.col(x) for x in c.columns])


@named(
    f"""{_SPEC}, e AS (SELECT k.cluster_label AS k, c.channel, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.cluster_label) AS p
  FROM (SELECT DISTINCT cluster_label FROM spec) k CROSS JOIN (SELECT DISTINCT channel FROM spec) c LEFT JOIN spec USING (cluster_label, channel)),
d AS (SELECT a.k AS a, b.k AS b, round(sum(a.p * b.p) / sqrt(sum(a.p * a.p) * sum(b.p * b.p)), 6) AS cosine, round(sum(abs(a.p - b.p)), 6) AS l1, round(sqrt(sum((a.p - b.p) * (a.p - b.p))), 6) AS l2 FROM e a JOIN e b ON a.channel = b.channel AND a.k < b.k GROUP BY 1, 2)
SELECT count(*) AS pairs, round(avg(cosine), 5) AS mean_cosine, round(avg(l1), 5) AS mean_l1, round(avg(l2), 5) AS mean_l2 FROM d"""
)
def spectrum_pair_means(spark, sf_dir):
    m = reports.pairwise_means(spectrum_pairwise(spark, sf_dir))
    return m.select("pairs", *[F.round(c, 5).alias(c) for c in m.columns[1:]])


@named(
    f"""{_W}, x AS (SELECT quantile_cont(QUAL, 0.005) AS x0, quantile_cont(QUAL, 0.995) AS x1, quantile_cont(SNVQ, 0.005) AS y0, quantile_cont(SNVQ, 0.995) AS y1 FROM fm)
SELECT CAST(least(15, greatest(0, floor((QUAL - x0) / ((x1 - x0) / 16)))) AS INT) AS x_bin, CAST(least(15, greatest(0, floor((SNVQ - y0) / ((y1 - y0) / 16)))) AS INT) AS y_bin, count(*) AS n, count(*) FILTER (NOT (QUAL BETWEEN x0 AND x1 AND SNVQ BETWEEN y0 AND y1)) AS clipped FROM fm, x GROUP BY 1, 2"""
)
def hist_2d_robust(spark, sf_dir):
    """Counts over the extent that holds all but the outermost half percent on each side."""
    fm = featuremap(spark, sf_dir)
    x, y = (histograms.robust_extent(fm, c, 0.5).first() for c in ("QUAL", "SNVQ"))
    return histograms.histogram_2d(fm, "QUAL", "SNVQ", (x.lo, x.hi, y.lo, y.hi), 16)


@named(
    """WITH s AS (SELECT vec_id, label, embedding FROM embeddings ORDER BY md5('9|' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 2000),
d AS (SELECT a.vec_id, a.label AS k, b.label AS other, sum(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2]))))) AS total, count(*) AS n FROM s a JOIN s b ON true GROUP BY ALL),
m AS (SELECT vec_id, max(total / greatest(n - 1, 1)) FILTER (k = other) AS i, min(total / n) FILTER (k <> other) AS o, max(n) FILTER (k = other) AS size FROM d GROUP BY vec_id)
SELECT count(*) AS n, round(avg(CASE WHEN size > 1 AND o IS NOT NULL THEN (o - i) / greatest(i, o) ELSE 0 END), 6) AS silhouette FROM m"""
)
def silhouette(spark, sf_dir):
    """Exact over a sample of 2,000 rows."""
    sample = sampling.exact_sample(_table(spark, sf_dir, "embeddings"), ["vec_id"], 2000, 9)
    return reports.silhouette(sample, "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


@named(
    """WITH p AS (SELECT nullif(l_tax, 0.02) AS a, l_discount AS ra, l_quantity AS b, l_linenumber * 7.0 AS rb FROM lineitem), e AS (SELECT 'a' AS feature, count(a) AS n, coalesce(sum((a - ra) * (a - ra)), 0) AS s FROM p UNION ALL SELECT 'b', count(b), coalesce(sum((b - rb) * (b - rb)), 0) FROM p)
SELECT feature, n, round(s / greatest(n, 1), 8) AS mse FROM e UNION ALL SELECT 'pooled', CAST(sum(n) AS BIGINT), round(sum(s) / greatest(sum(n), 1), 8) FROM e"""
)
def reconstruction_error(spark, sf_dir):
    l = _table(spark, sf_dir, "lineitem")
    features = {"a": (F.nullif(F.col("l_tax"), F.lit(0.02)), F.col("l_discount")), "b": (F.col("l_quantity"), F.col("l_linenumber") * 7.0)}
    return reports.reconstruction_error(l, features).withColumn("mse", F.round("mse", 8))


@named(
    """WITH e AS (SELECT i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), m AS (SELECT i, var_pop(x) AS variance, avg(0.5 * (x * x + 0.25 - ln(0.25) - 1)) AS divergence FROM e GROUP BY i)
SELECT CAST(i - 1 AS INT) AS dim, round(variance, 6) AS variance, round(divergence, 6) AS divergence, round(divergence, 6) < 0.4 OR round(variance, 6) < 0.015 AS collapsed FROM m"""
)
def latent_collapse(spark, sf_dir):
    """Dimensions whose divergence from the prior, at a deviation of one half, or whose variance is too small."""
    each = _table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "v")).withColumn("x", F.col("v").cast("double"))
    prior = F.avg(0.5 * (F.col("x") * F.col("x") + 0.25 - F.ln(F.lit(0.25)) - 1))
    own = each.groupBy("dim").agg(F.round(F.var_pop("x"), 6).alias("variance"), F.round(prior, 6).alias("divergence"))
    return reports.collapsed(own, "divergence", "variance", 0.4, 0.015)


# sample designs


@named(
    "WITH " + ", ".join(f"r{k} AS (SELECT {k} AS replicate, o_orderkey, row_number() OVER (ORDER BY {_O.format(3 + k)}, o_orderkey) AS p FROM orders)" for k in range(2)) + " SELECT replicate, size, o_orderkey FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1), (SELECT unnest([50, 200, 800]) AS size) WHERE p <= size"
)
def replicate_samples(spark, sf_dir):
    return sampling.nested_samples(_table(spark, sf_dir, "orders"), ["o_orderkey"], [50, 200, 800], 3, replicates=2).select("replicate", "size", "o_orderkey")


@named(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_O.format(3)}, o_orderkey) AS p FROM orders) SELECT o_orderkey FROM r WHERE p > 800 ORDER BY {_O.format(77)}, o_orderkey LIMIT 100")
def probe_sample(spark, sf_dir):
    """Rows that are in no sample."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey")
    return sampling.disjoint_probe(o, ["o_orderkey"], sampling.exact_sample(o, ["o_orderkey"], 800, 3), 100, 77)


@named(
    f"""WITH z AS (SELECT p_size AS g, count(*) AS n FROM part GROUP BY 1), c AS (SELECT q, sum(least(n, q)) AS taken FROM z, range(0, 2001) t(q) GROUP BY q), w AS (SELECT max(q) AS q FROM c WHERE taken <= 120),
r AS (SELECT p_partkey, p_size, row_number() OVER (PARTITION BY p_size ORDER BY md5('4|' || CAST(p_partkey AS VARCHAR)), p_partkey) AS p FROM part), x AS (SELECT count(*) AS many FROM z, w WHERE n > q)
SELECT p_size, least(any_value(z.n), any_value(w.q)) AS taken FROM r JOIN z ON g = p_size, w WHERE p <= w.q GROUP BY 1"""
)
def budget_sample(spark, sf_dir):
    """How many rows of each stratum a budget of 120 takes."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return sampling.budget_sample(part, "p_size", ["p_partkey"], 120, 4).groupBy("p_size").agg(F.count("*").alias("taken"))


@named(
    """WITH g AS (SELECT o_custkey % 10 * (o_custkey % 3) AS s, count(*) AS size FROM orders GROUP BY 1), b AS (SELECT unnest([4, 16, 256]) AS seats), q AS (SELECT seats, s, CAST(size AS DOUBLE) * seats / sum(size) OVER (PARTITION BY seats) AS quota FROM g, b),
p AS (SELECT *, row_number() OVER (PARTITION BY seats ORDER BY round(quota - floor(quota), 9) DESC, s) AS place, seats - sum(floor(quota)) OVER (PARTITION BY seats) AS rest FROM q), d AS (SELECT seats, floor(quota) + CASE WHEN place <= rest THEN 1 ELSE 0 END AS draw FROM p)
SELECT seats, count(*) AS groups, count(*) FILTER (draw <= 0) AS starved, seats < count(*) AS too_small, seats < count(*) OR count(*) FILTER (draw <= 0) > 0 AS refused FROM d GROUP BY seats"""
)
def draw_guard(spark, sf_dir):
    """Batches that would draw nothing from a source are refused."""
    sizes = checkpointed(_table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10 * (F.col("o_custkey") % 3)).alias("s")).agg(F.count("*").alias("size")))
    each = [sampling.starving(sampling.apportion(sizes, "s", "size", n), n).select(F.lit(n).alias("seats"), "*") for n in (4, 16, 256)]
    return each[0].unionAll(each[1]).unionAll(each[2])


@named(
    """WITH w AS (SELECT p_partkey, (sum(p_size) OVER (ORDER BY p_partkey) - p_size) / sum(p_size) OVER () AS lo, sum(p_size) OVER (ORDER BY p_partkey) / sum(p_size) OVER () AS hi FROM part), d AS (SELECT s_suppkey AS draw, s_suppkey * 0.6180339887498949 % 1 AS u FROM supplier)
SELECT draw, p_partkey FROM d JOIN w ON u >= lo AND u < hi"""
)
def weighted_draw(spark, sf_dir):
    """Parts drawn by their size, at places of a golden-ratio sequence."""
    draws = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("draw"), (F.col("s_suppkey") * 0.6180339887498949 % 1).alias("u"))
    part = _table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))
    return sampling.weighted_draw(part, "p_partkey", "p_size", draws, "u").select("draw", "p_partkey")


@named(f"SELECT o_orderkey, row_number() OVER (ORDER BY {_O.format(8)}, o_orderkey) <= greatest(1, least(floor(count(*) OVER () * 0.15), count(*) OVER () - 1)) AS is_val FROM orders")
def permutation_split(spark, sf_dir):
    return sampling.permutation_split(_table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.15, 8)


@named("SELECT o_orderstatus AS source, count(*) AS eligible, least(count(*), 4000) AS taken FROM orders GROUP BY 1")
def sample_clamp(spark, sf_dir):
    """What a request of 4,000 rows gets from each source."""
    sizes = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count("*").alias("eligible"))
    return sizes.withColumn("taken", F.least("eligible", F.lit(4000)))


# models given as tables


def _layers(spark, sf_dir) -> models.Layers:
    """Two layers read from the table: means of the labels' vectors as weights, so that an oracle can work them out."""
    rows = _table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array(*[F.round(F.avg(F.col("embedding")[i].cast("double")), 6) for i in range(64)]).alias("w")).orderBy("label").limit(4).collect()
    w = np.array([r.w for r in rows]).T
    return models.Layers([w, np.eye(w.shape[1])], [np.zeros(w.shape[1]), np.zeros(w.shape[1])])


_MEANS = "e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), w AS (SELECT label AS k, i, round(avg(x), 6) AS w FROM e WHERE label IN (SELECT DISTINCT label FROM embeddings ORDER BY label LIMIT 4) GROUP BY 1, 2)"


@named(
    f"""WITH {_MEANS}, y AS (SELECT vec_id, e.label AS own, dense_rank() OVER (ORDER BY k) - 1 AS j, greatest(sum(x * w), 0) AS y FROM e JOIN w USING (i) GROUP BY vec_id, e.label, k)
SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS row_index, vec_id, own AS label, {", ".join(f"round(max(y) FILTER (j = {j}), 4) AS latent_{j}" for j in range(4))} FROM y GROUP BY vec_id, own"""
)
def embed_table(spark, sf_dir):
    """Row number, ids and latent columns of all vectors under given weights."""
    e = _table(spark, sf_dir, "embeddings")
    made = models.apply_layers(e, _layers(spark, sf_dir), "vec_id", "embedding")
    numbered = joins.dense_index(e.select("vec_id", "label"), ["vec_id"]).join(made, "vec_id")
    return numbered.select("row_index", "vec_id", "label", *[F.round(F.col("latent")[j].cast("double"), 4).alias(f"latent_{j}") for j in range(4)])


@named(
    """WITH r AS (SELECT o_orderpriority AS cell, o_orderkey % 3 AS replicate, o_custkey AS k, min(o_orderstatus) AS label FROM orders GROUP BY 1, 2, 3), p AS (SELECT a.cell, a.replicate AS x, b.replicate AS y, avg(CAST(a.label = b.label AS INT)) AS s FROM r a JOIN r b ON a.cell = b.cell AND a.k = b.k AND a.replicate < b.replicate GROUP BY 1, 2, 3)
SELECT cell, count(*) AS pairs, round(avg(s), 8) AS same FROM p GROUP BY 1"""
)
def reproducibility(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("cell"), (F.col("o_orderkey") % 3).alias("replicate"), F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("label"))
    return reports.reproducibility(o, "cell", "replicate", "k", "label").withColumn("same", F.round("same", 8))


@named(
    """WITH c AS (SELECT DISTINCT o_orderpriority AS cell FROM orders), h AS (SELECT o_orderpriority AS cell, o_orderkey, o_custkey % 4 AS label FROM orders WHERE o_orderstatus = 'F'),
w AS (SELECT cell, count(*) AS n_held, count(*) FILTER (cell LIKE '2%' AND o_orderkey % 11 = 0) AS n_wrong FROM h GROUP BY 1)
SELECT cell, n_held, n_wrong, CASE WHEN cell LIKE '5%' THEN 'INCOMPLETE' WHEN n_wrong > 0 THEN 'INCONSISTENT' ELSE 'OK' END AS status FROM c JOIN w USING (cell)"""
)
def model_check(spark, sf_dir):
    """Saved cells against the rows that they held out: one has no metrics, one doesn't give some rows again."""
    o = _table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "cell")
    held = o.where("o_orderstatus = 'F'").select("cell", "o_orderkey", (F.col("o_custkey") % 4).alias("label"))
    again = held.where("NOT (cell LIKE '2%' AND o_orderkey % 11 = 0)")
    cells = o.select("cell").distinct().withColumn("has_metrics", ~F.col("cell").like("5%"))
    return reports.model_check(cells, held, again, "cell", "o_orderkey", "label")
