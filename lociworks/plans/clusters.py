"""Density of clusterings over the given vectors: spanning tree, condensed tree, prediction by it, validity, and how much the index prunes."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import balls, density
from ..sources.checkpoint import checkpointed
from ..sources.scan import table
from .named import named

#: Core distances of the fit are those of the fifth point.
_SAMPLES = 5


def _apart_sql(a: str, b: str) -> str:
    return f"round(sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))), 6)"


#: The least spanning tree by growing it point by point, in DuckDB's SQL.
_TREE_SQL = f"""f AS (SELECT vec_id AS id, embedding AS v FROM embeddings),
ff AS (SELECT a.id AS a, b.id AS b, {_apart_sql('a.v', 'b.v')} AS d FROM f a JOIN f b ON true),
core AS (SELECT id, d AS core FROM (SELECT a AS id, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM ff) WHERE r = {_SAMPLES}),
w AS MATERIALIZED (SELECT a, b, greatest(d, x.core, y.core) AS w FROM ff JOIN core x ON a = x.id JOIN core y ON b = y.id WHERE a <> b),
grown AS (
  SELECT 0 AS k, [min(id)] AS seen, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS BIGINT) AS lo, CAST(NULL AS BIGINT) AS hi FROM f
  UNION ALL
  SELECT k + 1, list_append(seen, b), w, least(a, b), greatest(a, b) FROM (
    SELECT k, any_value(seen) AS seen, arg_min(w.a, (w.w, least(a, b), greatest(a, b))) AS a, arg_min(w.b, (w.w, least(a, b), greatest(a, b))) AS b, min(w.w) AS w
    FROM grown JOIN w ON list_contains(seen, w.a) AND NOT list_contains(seen, w.b) GROUP BY k)
), tree AS MATERIALIZED (SELECT row_number() OVER (ORDER BY w, lo, hi) AS i, w, lo, hi, 1 / w AS lam FROM grown WHERE k > 0)"""

#: The condensed tree, by joining parts from the lightest edge on.
_CONDENSED_SQL = f"""{_TREE_SQL},
own AS (SELECT list(id ORDER BY id) AS ids FROM f),
places AS MATERIALIZED (SELECT i, lam, CAST(list_position(ids, lo) AS BIGINT) AS a, CAST(list_position(ids, hi) AS BIGINT) AS b FROM tree, own),
joined AS (
  SELECT CAST(0 AS BIGINT) AS i, range(1, len(ids) + 1) AS part, list_transform(ids, lambda x: CAST(0 AS BIGINT)) AS cl, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS before,
    CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y, CAST(0 AS BIGINT) AS cx, CAST(0 AS BIGINT) AS cy, CAST(0 AS BIGINT) AS cluster, CAST(0 AS DOUBLE) AS lam FROM own
  UNION ALL
  SELECT i, list_transform(part, lambda c: CASE WHEN c = y THEN x ELSE c END), list_transform(cl, lambda c, p: CASE WHEN p = x THEN cluster ELSE c END), greatest(n, cluster), part, x, y, cx, cy, cluster, lam FROM (
    SELECT *, CASE WHEN (cx > 0 AND cy > 0) OR (cx = 0 AND cy = 0 AND len(list_filter(part, lambda c: c = x OR c = y)) >= {density.LEAST}) THEN n + 1 ELSE greatest(cx, cy) END AS cluster FROM (
      SELECT *, cl[x] AS cx, cl[y] AS cy FROM (SELECT p.i, j.part, j.cl, j.n, p.lam, j.part[p.a] AS x, j.part[p.b] AS y FROM joined j JOIN places p ON p.i = j.i + 1)))
), fallen AS (
  SELECT ids[p] AS id, cluster, lam FROM joined, own, (SELECT unnest(range(1, len(ids) + 1)) AS p FROM own) WHERE cluster > 0 AND ((before[p] = x AND cx = 0) OR (before[p] = y AND cy = 0))
), ends AS (SELECT unnest([cx, cy]) AS cluster, cluster AS parent, lam AS birth FROM joined WHERE cx > 0 AND cy > 0),
named AS (SELECT cluster, coalesce(parent, cluster) AS parent, coalesce(birth, 0) AS birth FROM (SELECT DISTINCT cluster FROM joined WHERE cluster > 0) LEFT JOIN ends USING (cluster)),
up AS (SELECT cluster, cluster AS above FROM named UNION SELECT u.cluster, n.parent FROM up u JOIN named n ON u.above = n.cluster),
sizes AS (SELECT above AS cluster, count(*) AS size, min(id) AS first FROM fallen JOIN up USING (cluster) GROUP BY above),
masses AS (
  SELECT cluster, sum(n * (lam - birth)) AS mass, max(lam) AS top FROM (
    SELECT cluster, 1 AS n, lam FROM fallen UNION ALL SELECT parent, size, birth FROM named JOIN sizes USING (cluster) WHERE parent <> cluster) JOIN named USING (cluster) GROUP BY cluster
), kids AS (SELECT m.cluster, mass, list(k.cluster) FILTER (k.cluster IS NOT NULL) AS kids FROM masses m LEFT JOIN named k ON k.parent = m.cluster AND k.cluster <> m.cluster GROUP BY m.cluster, mass),
weighed AS (
  SELECT CAST(0 AS BIGINT) AS cluster, CAST([] AS DOUBLE[]) AS best, false AS heavy
  UNION ALL
  SELECT k.cluster, list_append(best, greatest(mass, coalesce(list_sum(list_transform(kids, lambda c: best[c])), 0))), coalesce(list_sum(list_transform(kids, lambda c: best[c])), 0) <= mass
  FROM weighed b JOIN kids k ON k.cluster = b.cluster + 1
), picked AS (SELECT u.cluster, max(u.above) FILTER (heavy AND n.parent <> n.cluster) AS pick FROM up u JOIN weighed b ON b.cluster = u.above JOIN named n ON n.cluster = u.above GROUP BY u.cluster),
labels AS (SELECT pick, row_number() OVER (ORDER BY first) - 1 AS label FROM (SELECT DISTINCT pick FROM picked WHERE pick IS NOT NULL) JOIN sizes ON pick = cluster),
clusters AS (
  SELECT n.cluster, n.parent, n.birth, size, m.mass, m.mass / (size * (SELECT max(top) FROM masses)) AS persistence, coalesce(label, -1) AS label, m2.top AS max_lambda, pick IS NOT DISTINCT FROM n.cluster AS chosen
  FROM named n JOIN sizes USING (cluster) JOIN masses m USING (cluster) JOIN picked USING (cluster) LEFT JOIN labels USING (pick) JOIN masses m2 ON m2.cluster = coalesce(pick, n.cluster)
)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.as_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "id")


@named(f"WITH RECURSIVE {_TREE_SQL} SELECT lo AS a, hi AS b, w FROM tree")
def spanning_tree(spark, sf_dir):
    """Edges of the least spanning tree of mutual reachability."""
    return density.tree_edges(checkpointed(density.with_core(_vectors(spark, sf_dir), _SAMPLES)))


@named(f"WITH RECURSIVE {_CONDENSED_SQL} SELECT cluster, parent, round(birth, 6) AS birth, size, round(mass, 4) AS stability, round(persistence, 6) AS persistence, label, round(max_lambda, 6) AS max_lambda, chosen FROM clusters")
def condensed_tree(spark, sf_dir):
    """Clusters of the condensed tree, with mass, persistence and those that are chosen."""
    _, clusters = density.fit_tree(_vectors(spark, sf_dir), _SAMPLES)
    long = [F.col(c).cast("long").alias(c) for c in ("cluster", "parent", "size", "label")]
    rounded = [F.round(c, n).alias(c) for c, n in (("birth", 6), ("stability", 4), ("persistence", 6), ("max_lambda", 6))]
    return clusters.select(*long, *rounded, "chosen")


@named(
    f"""WITH RECURSIVE {_CONDENSED_SQL},
near AS (SELECT q.vec_id AS q, f.id, {_apart_sql('q.embedding', 'f.v')} AS d FROM embeddings q JOIN f ON true),
n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, id) AS r FROM near),
m AS (SELECT q, min((greatest(d, core, own), r)) AS b, arg_min(id, (greatest(d, core, own), r)) AS id FROM n JOIN core USING (id) JOIN (SELECT q, d AS own FROM n WHERE r = {_SAMPLES + 1}) USING (q) WHERE r <= {2 * _SAMPLES} GROUP BY q),
c AS (SELECT q, 1 / b[1] AS lam, cluster, fallen.lam > 1 / b[1] AS climbs FROM m JOIN fallen USING (id)),
s AS (SELECT q, any_value(c.lam) AS lam, min(above) AS cluster FROM c JOIN up USING (cluster) JOIN named n ON n.cluster = above WHERE (NOT climbs AND above = c.cluster) OR (climbs AND (n.parent = n.cluster OR n.birth < c.lam)) GROUP BY q)
SELECT q AS vec_id, CAST(label AS INT) AS cluster_label, CASE WHEN label >= 0 THEN round(least(max_lambda, lam) / max_lambda, 4) ELSE 0 END AS cluster_probability FROM s JOIN clusters USING (cluster)"""
)
def predict_clusters(spark, sf_dir):
    """Labels of all rows by the condensed tree of all, which lies in a stored table."""
    points, clusters = density.fit_tree(_vectors(spark, sf_dir), _SAMPLES)
    queries = _vectors(spark, sf_dir).withColumnRenamed("id", "q")
    out = density.predict(queries, points, clusters, _SAMPLES)
    return out.select(F.col("q").alias("vec_id"), "cluster_label", F.round("cluster_probability", 4).alias("cluster_probability"))


#: Rows of a label that validity looks at here.
_EACH = 40

_VALIDITY_SQL = f"""s AS (SELECT * FROM (SELECT vec_id AS id, embedding AS v, label, row_number() OVER (PARTITION BY label ORDER BY md5('0|' || CAST(vec_id AS VARCHAR)), vec_id) AS r FROM embeddings) WHERE r <= {_EACH}),
d AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, {_apart_sql('a.v', 'b.v')} AS d FROM s a JOIN s b ON a.id <> b.id),
core AS (SELECT a AS id, round(pow(sum(CASE WHEN d > 0 THEN pow(1 / d, 64) ELSE 0 END) / count(*), -1.0 / 64), 6) AS core FROM d WHERE la = lb GROUP BY a),
w AS (SELECT a, b, la, lb, greatest(d, x.core, y.core) AS w FROM d JOIN core x ON a = x.id JOIN core y ON b = y.id),
inner_tree AS (
  SELECT label, 0 AS k, [min(id)] AS seen, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM s GROUP BY label
  UNION ALL
  SELECT label, k + 1, list_append(seen, nb), nw, na, nb FROM (
    SELECT label, any_value(k) AS k, any_value(seen) AS seen, min(w.w) AS nw, arg_min(w.a, (w.w, w.a, w.b)) AS na, arg_min(w.b, (w.w, w.a, w.b)) AS nb
    FROM inner_tree t JOIN w ON w.la = t.label AND w.lb = t.label AND list_contains(seen, w.a) AND NOT list_contains(seen, w.b) GROUP BY label)
), ends AS (SELECT label, unnest([a, b]) AS id FROM inner_tree WHERE k > 0),
internal AS (SELECT label, id FROM ends GROUP BY label, id HAVING count(*) > 1),
inside AS (SELECT label, id FROM internal UNION SELECT label, min(id) FROM s WHERE label NOT IN (SELECT label FROM internal) GROUP BY label),
heavy AS (SELECT t.label, coalesce(max(t.w) FILTER (x.id IS NOT NULL AND y.id IS NOT NULL), max(t.w)) AS sparseness FROM inner_tree t LEFT JOIN inside x ON t.a = x.id LEFT JOIN inside y ON t.b = y.id WHERE k > 0 GROUP BY t.label),
gaps AS (SELECT la AS label, min(w) AS separation FROM w JOIN inside x ON w.a = x.id JOIN inside y ON w.b = y.id WHERE la <> lb GROUP BY la),
scores AS (
  SELECT label, size, sampled, sparseness, separation, (separation - sparseness) / greatest(separation, sparseness) AS score
  FROM (SELECT label, count(*) AS size, least(count(*), {_EACH}) AS sampled FROM embeddings GROUP BY label) JOIN heavy USING (label) JOIN gaps USING (label)
)"""


@cache
def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@named(f"WITH RECURSIVE {_VALIDITY_SQL} SELECT label, size, sampled, {_rounded('sparseness', 'separation', 'score')} FROM scores")
def density_validity(spark, sf_dir):
    """Sparseness, separation and score of each label over a sample of its rows."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    out = density.validity(e, _EACH)
    return out.select("label", "size", "sampled", *[F.round(c, 6).alias(c) for c in ("sparseness", "separation", "score")])


@named(
    f"""WITH RECURSIVE {_VALIDITY_SQL} SELECT round(sum(score * size) / sum(size), 6) AS dbcv, round(sum(score * sampled) / sum(sampled), 6) AS dbcv_sample_weighted, round(avg(score), 6) AS dbcv_unweighted_mean,
  round(min(score), 6) AS dbcv_cluster_min, round(avg(CAST(score < 0 AS INT)), 6) AS frac_clusters_negative, round(coalesce(sum(size) FILTER (score < 0), 0) / sum(size), 6) AS point_share_negative FROM scores"""
)
def dbcv(spark, sf_dir):
    """Density-based validity of the labels, weighted by true sizes, and the share of negative clusters."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    out = density.validity_summary(density.validity(e, _EACH))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@named()
def knn_pruning(spark, sf_dir):
    """Pairs of a query and a row that the index of balls meets for 10 neighbours, of all, in the first two dimensions and in all."""
    e = table(spark, sf_dir, "embeddings")
    flat = e.withColumn("embedding", F.slice("embedding", 1, 2))
    each = []
    for width, rows in ((2, flat), (64, e)):
        queries = balls.as_vectors(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", "q")
        each.append(balls.met_share(queries, balls.build(rows), 10).select(F.lit(width).alias("width"), "*"))
    return each[0].unionAll(each[1])
