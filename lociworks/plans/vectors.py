"""Hash splits, samples, neighbours, latent statistics, models and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import encode, hashing
from ..operators import balls, latent, models, neighbours, quality, sampling, spectra
from ..sources import export, scan
from ..sources.checkpoint import checkpointed, own_path
from ..sources.featuremap import FM_SQL, featuremap
from ..streaming.spectrum_stream import early_stop
from .named import named
from .relational import _LONG as _MATRIX
from .relational import spectrum_of

_W = f"WITH {FM_SQL}"
#: Dimensions of the given vectors.
WIDTH = 64
SALT = hashing.stable_seed("global", 7)
_MOD = "CAST(18446744073709551616 AS UHUGEINT)"


def _sm_steps(name: str, source: str, columns: str, h: str) -> str:
    """Steps of SplitMix64 on the expression h as common table expressions; the last is called name."""
    u = lambda x: f"CAST({x} AS UHUGEINT)"
    return f"""{name}0 AS (SELECT {columns}, ({h} + {u(hashing.GAMMA)}) % {_MOD} AS z FROM {source}),
{name}1 AS (SELECT {columns}, (xor(z, z >> 30) % {_MOD}) * {u(hashing.MIX_A)} % {_MOD} AS z FROM {name}0),
{name}2 AS (SELECT {columns}, (xor(z, z >> 27) % {_MOD}) * {u(hashing.MIX_B)} % {_MOD} AS z FROM {name}1),
{name} AS (SELECT {columns}, xor(z, z >> 31) AS h FROM {name}2)"""


def _fnv(column: str) -> str:
    bytes_of = f"list_transform(string_split(coalesce({column}, ''), ''), lambda c: CAST(ord(c) AS UHUGEINT))"
    return f"CASE WHEN coalesce({column}, '') = '' THEN CAST({hashing.FNV_OFFSET} AS UHUGEINT) ELSE list_reduce(list_prepend(CAST({hashing.FNV_OFFSET} AS UHUGEINT), {bytes_of}), lambda h, b: xor(h, b) * CAST({hashing.FNV_PRIME} AS UHUGEINT) % {_MOD}) END"


def _split_sql(source: str, keys: list[tuple[str, bool]], fraction: float, salt: int) -> str:
    columns = ", ".join(k for k, _ in keys)
    parts = [_sm_steps("k", source, columns, f"CAST({hashing.START ^ salt} AS UHUGEINT)")]
    last = "k"
    for i, (key, text) in enumerate(keys):
        value = _fnv(key) if text else f"CAST(coalesce({key}, 0) AS UHUGEINT)"
        parts.append(_sm_steps(f"k{chr(97 + i)}", last, columns, f"xor(h, {value})"))
        last = f"k{chr(97 + i)}"
    return ",\n".join(parts) + f",\nspl AS (SELECT {columns}, h < CAST({hashing.threshold(fraction)} AS UHUGEINT) AS is_val FROM {last})"


_SITES = f"{_W}, sites AS (SELECT DISTINCT CHROM, POS, REF, ALT FROM fm), " + _split_sql("sites", [("CHROM", True), ("POS", False), ("REF", True), ("ALT", True)], 0.1, SALT)


def _sites(spark, sf_dir):
    return hashing.content_split(featuremap(spark, sf_dir).select("CHROM", "POS", "REF", "ALT").distinct(), ["CHROM", "POS", "REF", "ALT"], 0.1, SALT)


@named(f"{_SITES} SELECT CHROM, POS, REF, ALT, is_val FROM spl")
def split_site_hash(spark, sf_dir):
    return _sites(spark, sf_dir)


@named("WITH own AS (SELECT o_orderkey FROM orders), " + _split_sql("own", [("o_orderkey", False)], 0.25, SALT) + " SELECT o_orderkey, is_val FROM spl")
def split_row_hash(spark, sf_dir):
    return hashing.content_split(scan.table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 0.25, SALT)


_PROBED = "SELECT '{0}' AS design, round(sum(v) / sum(n), 8) AS row_share, round(avg(CAST(v = n AS INT)), 8) AS site_share, count(*) FILTER (v > 0 AND v < n) AS straddling FROM (SELECT count(*) AS n, count(*) FILTER (is_val) AS v FROM {1} GROUP BY CHROM, POS, REF, ALT)"


@named(
    f"""{_SITES}, rsp AS (WITH okeys AS (SELECT DISTINCT okey FROM fm), {_split_sql("okeys", [("okey", False)], 0.1, SALT)} SELECT * FROM spl)
{_PROBED.format("site", "fm JOIN spl USING (CHROM, POS, REF, ALT)")} UNION ALL {_PROBED.format("row", "fm JOIN rsp USING (okey)")}"""
)
def split_probe(spark, sf_dir):
    """A split by site leaves no site on both sides; one by another key does."""
    fm = featuremap(spark, sf_dir).select("CHROM", "POS", "REF", "ALT", "okey")

    def probe(keys: list[str], name: str):
        site = hashing.content_split(fm, keys, 0.1, SALT).groupBy("CHROM", "POS", "REF", "ALT").agg(F.count("*").alias("n"), F.count_if("is_val").alias("v"))
        return site.agg(F.lit(name).alias("design"), F.round(F.sum("v") / F.sum("n"), 8).alias("row_share"), F.round(F.avg((F.col("v") == F.col("n")).cast("double")), 8).alias("site_share"), F.count_if((F.col("v") > 0) & (F.col("v") < F.col("n"))).alias("straddling"))

    return probe(["CHROM", "POS", "REF", "ALT"], "site").unionAll(probe(["okey"], "row"))


_LARGE = "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey + 9007199254740993 END"


@named(f"WITH own AS (SELECT o_orderkey, {_LARGE} AS big FROM orders), " + _split_sql("own", [("big", False), ("o_orderkey", False)], 0.25, SALT) + " SELECT o_orderkey, is_val FROM spl")
def split_null_keys(spark, sf_dir):
    """Keys past 2 ** 53, some of them null."""
    own = scan.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_LARGE).alias("big"))
    return hashing.content_split(own, ["big", "o_orderkey"], 0.25, SALT).select("o_orderkey", "is_val")


_KEYS = ["o_orderkey"]
_O = "md5('3|' || CAST(o_orderkey AS VARCHAR))"


@named(f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {_O}, o_orderkey LIMIT 500")
def exact_sample(spark, sf_dir):
    return sampling.exact_sample(scan.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _KEYS, 500, 3)


@named(f"WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_O}, o_orderkey) AS p FROM orders) SELECT o_orderkey, size FROM r, (SELECT unnest([50, 200, 800]) AS size) WHERE p <= size")
def nested_sample(spark, sf_dir):
    return sampling.nested_samples(scan.table(spark, sf_dir, "orders"), _KEYS, [50, 200, 800], 3).drop("replicate")


@named(f"WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_O}, o_orderkey) AS p FROM orders) SELECT o_orderkey, o_orderstatus FROM r WHERE p <= 40")
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(scan.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", _KEYS, 40, 3)


_APP = """q AS (SELECT *, floor(quota) AS whole, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, o_orderpriority) AS place, 64 - sum(floor(quota)) OVER () AS seats
  FROM (SELECT o_orderpriority, count(*) AS size, CAST(count(*) AS DOUBLE) * 64 / sum(count(*)) OVER () AS quota FROM orders GROUP BY 1)),
app AS (SELECT o_orderpriority, size, CAST(whole + CASE WHEN place <= seats THEN 1 ELSE 0 END AS BIGINT) AS draw FROM q)"""


@named(f"WITH {_APP} SELECT * FROM app")
def apportion(spark, sf_dir):
    sizes = scan.table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("size"))
    return sampling.apportion(sizes, "o_orderpriority", "size", 64)


@named(f"WITH {_APP} SELECT o_orderkey, o_orderpriority, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_O}, o_orderkey) - 1) / draw) AS BIGINT) AS batch_id FROM orders JOIN app USING (o_orderpriority)")
def interleave_batches(spark, sf_dir):
    return sampling.interleaved(scan.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", _KEYS, 64, 3)


@named("WITH g AS (SELECT DISTINCT o_orderpriority, o_custkey FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('5|1|' || o_orderpriority || '|' || CAST(o_custkey AS VARCHAR)), o_custkey) - 1 AS p FROM g) SELECT o_orderpriority, o_custkey FROM r WHERE p % 4 = 6 % 4")
def epoch_shard(spark, sf_dir):
    groups = scan.table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey").distinct()
    return sampling.epoch_shard(groups, "o_orderpriority", "o_custkey", epoch=6, shards=4, seed=5)


def _knn_sql(name: str, dims: str, k: int, itself: bool = False, queries: str = " WHERE q.vec_id % 100 = 0") -> str:
    d = f"round(sqrt(list_sum(list_transform(list_zip({dims.format('q')}, {dims.format('e')}), lambda x: (CAST(x[1] AS DOUBLE) - x[2]) * (CAST(x[1] AS DOUBLE) - x[2])))), 6)"
    return f"{name} AS (SELECT * FROM (SELECT q.vec_id AS q, e.vec_id AS id, {d} AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {d}, e.vec_id) AS place FROM embeddings q JOIN embeddings e ON {'true' if itself else 'q.vec_id <> e.vec_id'}{queries}) WHERE place <= {k})"


_KNN = "WITH " + _knn_sql("nn", "{}.embedding", 10)


def _knn(spark, sf_dir, k, itself=False, dims=None, queries="vec_id % 100 = 0"):
    e = scan.table(spark, sf_dir, "embeddings")
    if dims:
        e = e.withColumn("embedding", F.slice("embedding", 1, dims))
    return neighbours.knn_join(e.where(queries), e, k, itself=itself)


@named(f"{_KNN} SELECT q, id, distance, place FROM nn")
def knn_join(spark, sf_dir):
    return _knn(spark, sf_dir, 10)


@named(f"WITH {_knn_sql('nn', '{}.embedding', 10, queries='')}, {_knn_sql('low', '{}.embedding[1:16]', 10, queries='')} SELECT q, round(count(low.id) / 10, 6) AS overlap FROM nn LEFT JOIN low USING (q, id) GROUP BY q")
def knn_overlap(spark, sf_dir):
    """Of every row's neighbours the share that are its neighbours in the first 16 dimensions too."""
    near, low = (_knn(spark, sf_dir, 10, dims=dims, queries="true") for dims in (None, 16))
    return neighbours.knn_overlap(near, low, 10).withColumn("overlap", F.round("overlap", 6))


@named(f"{_KNN} SELECT q, round(avg(CAST(a.label = b.label AS INT)), 6) AS same FROM nn JOIN embeddings a ON nn.id = a.vec_id JOIN embeddings b ON nn.q = b.vec_id GROUP BY q")
def connectivity(spark, sf_dir):
    labels = scan.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return neighbours.connectivity(_knn(spark, sf_dir, 10), labels).withColumn("same", F.round("same", 6))


@named(f"{_KNN} SELECT q, round(sum(embedding[1] / (distance + 1e-8)) / sum(1 / (distance + 1e-8)), 5) AS x, round(sum(embedding[2] / (distance + 1e-8)) / sum(1 / (distance + 1e-8)), 5) AS y FROM nn JOIN embeddings ON vec_id = id GROUP BY q")
def knn_interpolate(spark, sf_dir):
    xy = scan.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return neighbours.interpolate(_knn(spark, sf_dir, 10), xy, ["x", "y"]).select("q", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@named("WITH " + _knn_sql("nn", "{}.embedding", 5, True) + " SELECT q, distance AS core FROM nn WHERE place = 5")
def core_distance(spark, sf_dir):
    return neighbours.core_distance(_knn(spark, sf_dir, 5, itself=True), 5)


_ALL = f"WITH {_knn_sql('nn', '{}.embedding', 1000000)}, {_knn_sql('low', '{}.embedding[1:16]', 1000000)}, c AS (SELECT count(*) AS n, count(*) FILTER (vec_id % 100 = 0) AS m FROM embeddings)"


def _penalty_sql(near: str, far: str) -> str:
    return f"(SELECT sum(greatest({far}.place - 10, 0)) FROM {near} JOIN {far} ON {near}.q = {far}.q AND {near}.id = {far}.id WHERE {near}.place <= 10)"


def _both_ways(e, other, k, queries="vec_id % 100 = 0"):
    """(near, near by other, ranks of other's ten nearest in e, ranks of e's in other) of the queries; each table is indexed once."""
    index = [balls.build(x) for x in (e, other)]
    near = [checkpointed(neighbours.knn_join(x.where(queries), x, k, index=i)) for x, i in zip((e, other), index)]
    ten = [x.where("place <= 10") for x in near]
    return *near, neighbours.ranks_among_all(ten[1], e, index=index[0]), neighbours.ranks_among_all(ten[0], other, index=index[1])


@named(
    f"""{_ALL}, q AS (SELECT k, count(*) FILTER (greatest(nn.place, low.place) <= k) / (any_value(m) * k) AS q, any_value(n) AS n FROM nn JOIN low USING (q, id), c, range(1, 11) t(k) GROUP BY k),
r AS (SELECT max(q) FILTER (k = 10) AS q_nx, sum(((n - 1) * q - k) / (n - 1 - k) / k) / sum(1 / k) AS r_nx_auc FROM q)
SELECT round(1 - 2 / (m * 10 * (2 * n - 31)) * {_penalty_sql('low', 'nn')}, 6) AS trustworthiness, round(1 - 2 / (m * 10 * (2 * n - 31)) * {_penalty_sql('nn', 'low')}, 6) AS continuity,
  round(q_nx, 6) AS q_nx, round(r_nx_auc, 6) AS r_nx_auc FROM c, r"""
)
def coranking(spark, sf_dir):
    e = scan.table(spark, sf_dir, "embeddings")
    high, low, *ranks = _both_ways(e, e.withColumn("embedding", F.slice("embedding", 1, 16)), 10)
    out = neighbours.coranking(high, low, *ranks, 10, e.count())
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@named(f"{_KNN}, s AS (SELECT q, avg(CAST(a.label = b.label AS INT)) AS same FROM nn JOIN embeddings a ON nn.id = a.vec_id JOIN embeddings b ON nn.q = b.vec_id GROUP BY q) SELECT round(avg(same), 6) AS mean, round(median(same), 6) AS median, round(avg(CAST(same >= 1 AS INT)), 6) AS pure, round(avg(CAST(same < 0.5 AS INT)), 6) AS under_half FROM s")
def connectivity_summary(spark, sf_dir):
    labels = scan.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    out = neighbours.connectivity_summary(neighbours.connectivity(_knn(spark, sf_dir, 10), labels))
    return out.select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "pure", "under_half")])


@named(f"{_KNN} SELECT q, k, round(sum(embedding[1] / (distance + 1e-8)) / sum(1 / (distance + 1e-8)), 5) AS x FROM nn JOIN embeddings ON vec_id = id, (SELECT unnest([3, 5, 10]) AS k) WHERE place <= k GROUP BY q, k")
def knn_interpolate_many(spark, sf_dir):
    """Several numbers of neighbours from one search."""
    near = checkpointed(_knn(spark, sf_dir, 10))
    x = scan.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"))
    each = [neighbours.interpolate(near.where(F.col("place") <= k), x, ["x"]).select("q", F.lit(k).alias("k"), F.round("x", 5).alias("x")) for k in (3, 5, 10)]
    return each[0].unionAll(each[1]).unionAll(each[2])


@named("SELECT i - 1 AS dim, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS mean, round(var_pop(CAST(embedding[i] AS DOUBLE)), 6) AS variance, var_pop(CAST(embedding[i] AS DOUBLE)) >= 0.01 AS active FROM embeddings, range(1, 65) t(i) GROUP BY i")
def latent_activation(spark, sf_dir):
    a = latent.activation(scan.table(spark, sf_dir, "embeddings"), "embedding", WIDTH)
    return a.select(F.col("dim").cast("bigint").alias("dim"), F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), "active")


_LONG = "e AS (SELECT vec_id, label AS k, i, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) t(i)), c AS (SELECT k, i, avg(x) AS c, var_pop(x) AS v, count(*) AS n FROM e GROUP BY k, i)"


@named(f"WITH {_LONG} SELECT k AS label, n AS size, CAST(i - 1 AS INT) AS dim, round(c, 6) AS mean FROM c")
def centroids(spark, sf_dir):
    e = scan.table(spark, sf_dir, "embeddings")
    means = e.groupBy("label").agg(F.count("*").alias("size"), F.array(*[F.avg(c) for c in latent.columns_of("embedding", WIDTH)]).alias("m"))
    return means.select("label", "size", F.posexplode("m").alias("dim", "mean")).withColumn("mean", F.round("mean", 6))


_HALVES = """w AS (SELECT i, j, covar_pop(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)) * count(*) AS p, sum(CAST(embedding[i] AS DOUBLE) * embedding[j]) AS raw FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) GROUP BY i, j),
f AS (SELECT sum(p * p) FILTER (i <= 32 AND j > 32) AS ab, sum(p * p) FILTER (i <= 32 AND j <= 32) AS aa, sum(p * p) FILTER (i > 32 AND j > 32) AS bb, sum(p) FILTER (i = j AND i <= 32) AS trace,
  sum(raw * raw) FILTER (i <= 32 AND j > 32) AS rab, sum(raw * raw) FILTER (i <= 32 AND j <= 32) AS raa, sum(raw * raw) FILTER (i > 32 AND j > 32) AS rbb FROM w)"""


def _halves(spark, sf_dir) -> dict:
    x = latent.columns_of("embedding", WIDTH)
    return latent.cross_moments(scan.table(spark, sf_dir, "embeddings"), x[: WIDTH // 2], x[WIDTH // 2 :])


@named(f"WITH {_HALVES} SELECT round(ab / sqrt(aa * bb), 6) AS linear_cka, round(1 - sqrt(greatest(raa + rbb - 2 * rab, 0)) / sqrt(raa * rbb), 6) AS gram_likeness, round(trace * trace / aa, 5) AS participation FROM f")
def latent_likeness(spark, sf_dir):
    """Likeness of both halves of all vectors: CKA, Gram likeness, and the participation ratio of the first."""
    m = _halves(spark, sf_dir)
    row = (round(latent.linear_cka(m), 6), round(latent.gram_likeness(m), 6), round(latent.participation_ratio(m), 5))
    return spark.createDataFrame([row], "linear_cka double, gram_likeness double, participation double")


def _sum_sql(x: str, a: int, b: int) -> str:
    return f"list_sum(list_transform({x}[{a}:{b}], lambda v: CAST(v AS DOUBLE)))"


def _sum_of(a: int, b: int):
    """The sum of the dimensions a to b, from 1."""
    return F.aggregate(F.transform(F.slice("embedding", a, b - a + 1), lambda v: v.cast("double")), F.lit(0.0), lambda s, v: s + v)


#: The sum of both singular values of the cross product of two tables of two columns is sqrt(sum of squares + 2 |determinant|).
_QUARTERS = [(1, 16), (17, 32), (33, 48), (49, 64)]


@named(
    f"""WITH t AS (SELECT {", ".join(f"{_sum_sql('embedding', a, b)} AS q{i}" for i, (a, b) in enumerate(_QUARTERS))} FROM embeddings),
c AS (SELECT count(*) * covar_pop(q0, q2) AS m00, count(*) * covar_pop(q0, q3) AS m01, count(*) * covar_pop(q1, q2) AS m10, count(*) * covar_pop(q1, q3) AS m11, count(*) * sqrt((var_pop(q0) + var_pop(q1)) * (var_pop(q2) + var_pop(q3))) AS norm FROM t),
s AS (SELECT sqrt(m00 * m00 + m01 * m01 + m10 * m10 + m11 * m11 + 2 * abs(m00 * m11 - m01 * m10)) / norm AS total FROM c)
SELECT round(2 - 2 * total, 6) AS disparity, round(1 - total * total, 6) AS disparity_squared FROM s"""
)
def latent_disparity(spark, sf_dir):
    """Procrustes disparities of two plane tables, of sums over quarters of the vectors."""
    x = [_sum_of(a, b) for a, b in _QUARTERS]
    m = latent.cross_moments(scan.table(spark, sf_dir, "embeddings"), x[:2], x[2:])
    row = (round(latent.procrustes(m), 6), round(latent.procrustes(m, squared=True), 6))
    return spark.createDataFrame([row], "disparity double, disparity_squared double")


_PLANE_SQL = f"[{_sum_sql('{0}.embedding', 1, 32)}, {_sum_sql('{0}.embedding', 33, 64)}]"


def _overlap_sql(k: int) -> str:
    return f"(SELECT avg(j) FROM (SELECT q, count(low.id) / (2 * {k} - count(low.id)) AS j FROM nn LEFT JOIN (SELECT * FROM low WHERE place <= {k}) low USING (q, id) WHERE nn.place <= {k} GROUP BY q))"


@named(
    f"""WITH {_knn_sql('nn', '{0}.embedding', 1000000, queries='')}, {_knn_sql('low', _PLANE_SQL, 1000000, queries='')}, c AS (SELECT count(*) AS n, count(*) AS m FROM embeddings),
t AS (SELECT vec_id, embedding AS v, {_sum_sql('embedding', 1, 32)} AS a, {_sum_sql('embedding', 33, 64)} AS b FROM embeddings),
e AS (SELECT i, a, b, CAST(v[i] AS DOUBLE) AS x FROM t, range(1, 65) r(i)), x AS (SELECT i, count(*) * covar_pop(x, a) AS ma, count(*) * covar_pop(x, b) AS mb, count(*) * var_pop(x) AS vx FROM e GROUP BY i),
g AS (SELECT sum(ma * ma) AS aa, sum(ma * mb) AS ab, sum(mb * mb) AS bb, sum(vx) AS trace FROM x),
w AS (SELECT sum(p * p) AS high FROM (SELECT covar_pop(CAST(v[i] AS DOUBLE), CAST(v[j] AS DOUBLE)) * count(*) AS p FROM t, range(1, 65) r(i), range(1, 65) s(j) GROUP BY i, j)),
y AS (SELECT count(*) * var_pop(a) AS va, count(*) * var_pop(b) AS vb, count(*) * covar_pop(a, b) AS cab FROM t)
SELECT round((aa + bb) / sqrt(high * (va * va + vb * vb + 2 * cab * cab)), 6) AS linear_cka, round(2 - 2 * sqrt(aa + bb + 2 * sqrt(greatest(aa * bb - ab * ab, 0))) / sqrt(trace * (va + vb)), 6) AS disparity,
  round({_overlap_sql(10)}, 6) AS jaccard_10, round({_overlap_sql(30)}, 6) AS jaccard_30,
  round(1 - 2 / (m * 10 * (2 * n - 31)) * (SELECT sum(greatest(nn.place - 10, 0)) FROM low JOIN nn USING (q, id) WHERE low.place <= 10), 6) AS trustworthiness,
  round(1 - 2 / (m * 10 * (2 * n - 31)) * (SELECT sum(greatest(low.place - 10, 0)) FROM nn JOIN low USING (q, id) WHERE nn.place <= 10), 6) AS continuity FROM g, w, y, c"""
)
def latent_record(spark, sf_dir):
    """Vectors against their projection to a plane, in one record: CKA, Procrustes, neighbours in common, trustworthiness and continuity."""
    e = scan.table(spark, sf_dir, "embeddings")
    plane = e.withColumn("embedding", F.array(_sum_of(1, 32), _sum_of(33, 64)))
    m = latent.cross_moments(e, latent.columns_of("embedding", WIDTH), [_sum_of(1, 32), _sum_of(33, 64)])
    high, low, *ranks = _both_ways(e, plane, 30, queries="true")
    ten = [x.where("place <= 10") for x in (high, low)]
    out = neighbours.coranking(*ten, *ranks, 10, e.count()).select("trustworthiness", "continuity")
    for k in (10, 30):
        shared = neighbours.knn_overlap(high, low, k).select((F.col("overlap") / (2 - F.col("overlap"))).alias("j"))
        out = out.withColumn(f"jaccard_{k}", shared.agg(F.avg("j")).scalar())
    out = out.withColumns({"linear_cka": F.lit(latent.linear_cka(m)), "disparity": F.lit(latent.procrustes(m))})
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@named("SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(covar_pop(CAST(embedding[i] AS DOUBLE), CAST(embedding[j] AS DOUBLE)), 6) AS covariance FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY i, j")
def latent_covariance(spark, sf_dir):
    x = latent.columns_of("embedding", WIDTH)
    m = latent.cross_moments(scan.table(spark, sf_dir, "embeddings"), x, [])
    rows = [(i, j, round(float(m["aa"][i, j] / m["n"]), 6)) for i in range(WIDTH) for j in range(i, WIDTH)]
    return spark.createDataFrame(rows, "i int, j int, covariance double")


#: Categories of the encoder and their codes, numbers with mean and deviation, and the widths of what comes after.
_CATEGORIES = [
    encode.FeatureSpec("REF", "c", {"": 0, "A": 1, "C": 2, "G": 3, "T": 4}),
    encode.FeatureSpec("ALT", "c", {"": 0, "A": 1, "C": 2, "G": 3, "T": 4}),
    encode.FeatureSpec("st", "c", {"": 0, "MIXED": 1}),
]
_NUMBERS = {"MAPQ": (0.04, 0.025), "SNVQ": (38_000.0, 23_000.0), "QUAL": (25.0, 14.0)}
_EACH, _HIDDEN, _LATENT = 2, 4, 2


def _encoder_parts() -> list[tuple[str, str, int, int]]:
    """(part, name, rows, columns) of all that the encoder has, in the order in which its numbers are taken from a table."""
    wide = _EACH * len(_CATEGORIES) + len(_NUMBERS)
    parts = [("table", c.name, len(c.codes), _EACH) for c in _CATEGORIES]
    return [*parts, ("weight", "0", wide, _HIDDEN), ("bias", "0", 1, _HIDDEN), ("weight", "1", _HIDDEN, _LATENT), ("bias", "1", 1, _LATENT)]


def _stored_weights(spark, sf_dir):
    """Weights in a stored table; their numbers are prices of parts, which stand for trained ones."""
    cells = [(part, name, i, j) for part, name, n, m in _encoder_parts() for i in range(n) for j in range(m)]
    place = spark.createDataFrame([(k, *c) for k, c in enumerate(cells)], "k long, part string, name string, i int, j int")
    prices = scan.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_retailprice") * F.lit(7.3) % 2 - 1).alias("w"))
    path = own_path(spark, "encoder")
    place.join(prices, "k").drop("k").write.parquet(path)
    return spark.read.parquet(path)


def _encoder_sql() -> str:
    begin, at = {}, 0
    for part, name, n, m in _encoder_parts():
        begin[part, name], at = at, at + n * m
    cell = lambda part, name, m, i, j: f"w[{begin[part, name] + 1} + ({i}) * {m} + {j}]"
    code = lambda c: f"CASE {c.name} " + " ".join(f"WHEN '{v}' THEN {k}" for v, k in c.codes.items()) + " ELSE 0 END"
    number = lambda c, mean, std: f"CASE WHEN {c} IS NULL THEN 0 ELSE CAST((CAST({c} AS FLOAT) - CAST({mean} AS FLOAT)) / CAST({std} AS FLOAT) AS DOUBLE) END"
    x = [cell("table", c.name, _EACH, code(c), d) for c in _CATEGORIES for d in range(_EACH)] + [number(c, *ms) for c, ms in _NUMBERS.items()]
    layer = lambda name, names, m, j: " + ".join([cell("bias", name, m, 0, j), *(f"{v} * {cell('weight', name, m, i, j)}" for i, v in enumerate(names))])
    xs, hs = [f"x{i}" for i in range(len(x))], [f"h{j}" for j in range(_HIDDEN)]
    return f"""{_W}, p AS (SELECT list(p_retailprice * CAST(7.3 AS DOUBLE) % 2 - 1 ORDER BY p_partkey) AS w FROM part),
x AS (SELECT okey, DP, w, {", ".join(f"{v} AS {n}" for v, n in zip(x, xs))} FROM fm, p),
h AS (SELECT okey, DP, w, {", ".join(f"greatest({layer('0', xs, _HIDDEN, j)}, 0) AS h{j}" for j in range(_HIDDEN))} FROM x)
SELECT okey, DP, {", ".join(f"round({layer('1', hs, _LATENT, j)}, 5) AS latent_{j}" for j in range(_LATENT))} FROM h"""


@named(_encoder_sql())
def encode_latent(spark, sf_dir):
    """Latent columns of all observations: categories and masked numbers through an encoder that is read from a stored table."""
    made = models.encode_mixed(featuremap(spark, sf_dir), ["okey", "DP"], _CATEGORIES, _NUMBERS, _stored_weights(spark, sf_dir))
    return made.select("okey", "DP", *[F.round(F.col("latent")[j], 5).alias(f"latent_{j}") for j in range(_LATENT)])


#: Rows whose shares of channels are the signatures.
_SIGNATURES = {"s1": "DP % 4 IN (0, 1)", "s2": "DP % 4 IN (1, 2)", "s3": "okey % 2 = 0"}


def _subsets_sql() -> str:
    """Of the solutions over each subset of three signatures, by Cramer's rule, those without negative activities."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    det3 = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    out = ["0, 0, 0"]
    for i in (1, 2, 3):
        out.append(", ".join(f"t{i} / {g(i, i)}" if k == i else "0" for k in (1, 2, 3)))
    for i, j in ((1, 2), (1, 3), (2, 3)):
        det = f"({g(i, i)} * {g(j, j)} - {g(i, j)} * {g(i, j)})"
        own = {i: f"(t{i} * {g(j, j)} - t{j} * {g(i, j)}) / {det}", j: f"(t{j} * {g(i, i)} - t{i} * {g(i, j)}) / {det}"}
        out.append(", ".join(own.get(k, "0") for k in (1, 2, 3)))
    whole = [[g(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    out.append(", ".join(f"{det3([[f't{i + 1}' if j == k else whole[i][j] for j in range(3)] for i in range(3)])} / {det3(whole)}" for k in range(3)))
    return " UNION ALL ".join(f"SELECT cluster_label, n, t1, t2, t3, {', '.join(f'{x} AS h{k}' for k, x in enumerate(hs.split(', '), 1))} FROM m" for hs in out)


@named(
    f"""{_MATRIX}, sig AS (SELECT channel, {", ".join(f"coalesce(count(*) FILTER ({w}) / sum(count(*) FILTER ({w})) OVER (), 0) AS {k}" for k, w in _SIGNATURES.items())} FROM lab WHERE cluster_label >= 0 AND channel IS NOT NULL GROUP BY channel),
gram AS (SELECT {", ".join(f"sum(s{i} * s{j}) AS g{i}{j}" for i in (1, 2, 3) for j in range(i, 4))} FROM sig),
m AS (SELECT cluster_label, {", ".join(f"any_value(g{i}{j}) AS g{i}{j}" for i in (1, 2, 3) for j in range(i, 4))}, sum(n) AS n, {", ".join(f"sum(n * s{i}) AS t{i}" for i in (1, 2, 3))} FROM lng JOIN sig USING (channel), gram GROUP BY cluster_label),
sol AS ({_subsets_sql()}), best AS (SELECT cluster_label, arg_max((h1, h2, h3), h1 * t1 + h2 * t2 + h3 * t3) AS h FROM sol WHERE least(h1, h2, h3) >= 0 GROUP BY cluster_label),
fit AS (SELECT cluster_label, any_value(h) AS h, sum(n * y) / sqrt(sum(n * n) * sum(y * y)) AS cosine, sum(abs(n - y)) / sum(n) AS l1, {", ".join(f"sum(s{i} * (n - y)) AS d{i}" for i in (1, 2, 3))}
  FROM (SELECT *, s1 * h[1] + s2 * h[2] + s3 * h[3] AS y FROM lng JOIN best USING (cluster_label) JOIN sig USING (channel)) GROUP BY cluster_label)
SELECT cluster_label, round(h[1], 3) AS s1, round(h[2], 3) AS s2, round(h[3], 3) AS s3, round(cosine, 6) AS cosine, round(l1, 6) AS l1_share,
  {" AND ".join(f"(h[{i}] > 0 OR d{i} <= 1e-6)" for i in (1, 2, 3))} AS optimal FROM fit"""
)
def signature_fit(spark, sf_dir):
    """Activities of three signatures, read from a TSV, in the spectrum of each cluster, and whether the solution is optimal."""
    of_cluster = checkpointed(spectrum_of(spark, sf_dir, **{k: F.count_if(F.expr(w)) for k, w in _SIGNATURES.items()}))
    counts = of_cluster.groupBy("channel").agg(*[F.sum(k).alias(k) for k in _SIGNATURES])
    totals = counts.agg(*[F.sum(k).alias(f"all_{k}") for k in _SIGNATURES])  # one row
    path = own_path(spark, "signatures")
    export.write_tsv(counts.join(F.broadcast(totals)).select(F.col("channel").alias("Type"), *[(F.col(k) / F.col(f"all_{k}")).alias(k) for k in _SIGNATURES]), path)
    signatures = scan.read_tsv(spark, path).withColumnRenamed("Type", "channel")
    fit = models.signature_fit(spectra.matrix_long(of_cluster.select("cluster_label", "channel", "n")), "cluster_label", "channel", "n", signatures)
    own = [F.round(F.col("activities")[k], 3).alias(k) for k in _SIGNATURES]
    return fit.select("cluster_label", *own, F.round("cosine", 6).alias("cosine"), F.round(F.col("l1") / F.col("total"), 6).alias("l1_share"), (F.col("gradient") <= 1e-6).alias("optimal"))


@named(
    f"""{_W} SELECT CHROM, POS, REF, ALT, concat_ws(chr(9), CHROM, CAST(POS AS VARCHAR), '.', REF, ALT, printf('%g', QUAL), CASE WHEN FILT = 1 THEN 'PASS' ELSE '.' END,
  'CLUSTER=' || cluster_label || ';CLPROB=' || printf('%g', cluster_probability) || ';SRC_FILT=' || FILT) AS line FROM fm WHERE cluster_label IN (0, 3)"""
)
def vcf_lines(spark, sf_dir):
    return export.vcf_lines(featuremap(spark, sf_dir).where("cluster_label IN (0, 3)"))


@named("WITH g AS (SELECT a, b FROM (SELECT unnest([5, 15, 25]) AS a), (SELECT DISTINCT label AS b FROM embeddings)) SELECT a, CAST(b AS INT) AS b FROM g WHERE a * 100 <= 2000 AND NOT (a = 5 AND b % 2 = 0)")
def grid_resume(spark, sf_dir):
    """Cells of a parameter grid that are affordable and not done yet."""
    grid = scan.table(spark, sf_dir, "embeddings").select(F.col("label").alias("b")).distinct().withColumn("a", F.explode(F.array(F.lit(5), F.lit(15), F.lit(25))))
    done = grid.where("a = 5 AND b % 2 = 0")
    return grid.where("a * 100 <= 2000").join(done, ["a", "b"], "left_anti").select("a", F.col("b").cast("int").alias("b"))


_STOP = """WITH RECURSIVE d AS (SELECT event_type, datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS epoch, avg(value) AS loss FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM d),
s AS (SELECT event_type, r, n, loss AS best, 0 AS stagnant, CAST(NULL AS BIGINT) AS stopped_at FROM o WHERE r = 1
  UNION ALL SELECT o.event_type, o.r, o.n, CASE WHEN stopped_at IS NOT NULL THEN best ELSE least(best, loss) END,
    CASE WHEN stopped_at IS NOT NULL THEN stagnant WHEN (best - loss) / greatest(abs(best), 1e-8) > 1e-3 THEN 0 ELSE stagnant + 1 END,
    CASE WHEN stopped_at IS NOT NULL THEN stopped_at WHEN NOT (best - loss) / greatest(abs(best), 1e-8) > 1e-3 AND stagnant + 1 >= 3 THEN epoch END
  FROM s JOIN o ON o.event_type = s.event_type AND o.r = s.r + 1)
SELECT event_type, round(best, 9) AS best, stagnant, stopped_at FROM s WHERE r = n"""


@named(_STOP)
def early_stop_fold(spark, sf_dir):
    """Where training on each event type's daily mean value would stop."""
    daily = scan.table(spark, sf_dir, "events").groupBy("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("epoch")).agg(F.avg("value").alias("loss"), F.lit(16).cast("long").alias("active"))
    ordered = daily.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("epoch", "loss", "active"))).alias("epochs"))
    return ordered.select("event_type", early_stop(F.col("epochs"), 1e-3, 3).alias("s")).select("event_type", F.round("s.best", 9).alias("best"), "s.stagnant", "s.stopped_at")


@named(
    f"""WITH {_LONG}, d AS (SELECT vec_id, e.k, sqrt(sum((x - c) * (x - c))) AS d FROM e JOIN c USING (k, i) GROUP BY ALL), s AS (SELECT k, avg(d) AS s FROM d GROUP BY k),
p AS (SELECT a.k AS a, b.k AS b, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.i = b.i AND a.k <> b.k GROUP BY ALL)
SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT max((x.s + y.s) / d) AS r FROM p JOIN s x ON x.k = a JOIN s y ON y.k = b GROUP BY a)"""
)
def davies_bouldin(spark, sf_dir):
    return quality.davies_bouldin(scan.table(spark, sf_dir, "embeddings"), "label", latent.columns_of("embedding", WIDTH)).select(F.round("davies_bouldin", 6).alias("davies_bouldin"))


@named(
    f"""WITH {_LONG}, g AS (SELECT i, avg(x) AS m FROM e GROUP BY i), b AS (SELECT sum(n * (c - m) * (c - m)) AS between_, sum(n * v) AS within FROM c JOIN g USING (i)), t AS (SELECT count(*) AS n, count(DISTINCT label) AS g FROM embeddings)
SELECT round(between_ * (n - g) / (within * (g - 1)), 4) AS calinski_harabasz FROM b, t"""
)
def calinski_harabasz(spark, sf_dir):
    return quality.calinski_harabasz(scan.table(spark, sf_dir, "embeddings"), "label", latent.columns_of("embedding", WIDTH)).select(F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@named(
    """WITH e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS a, CAST(embedding[i + 32] AS DOUBLE) AS b FROM embeddings, range(1, 33) t(i)),
u AS (SELECT sqrt(avg(v)) AS u FROM (SELECT var_pop(a) AS v FROM e GROUP BY i)), d AS (SELECT sqrt(sum((a - b) * (a - b))) / any_value(u) AS d FROM e, u GROUP BY vec_id)
SELECT round(avg(d), 5) AS mean, round(median(d), 5) AS median, round(quantile_cont(d, 0.95), 5) AS p95 FROM d"""
)
def embedding_error(spark, sf_dir):
    x = latent.columns_of("embedding", WIDTH)
    out = quality.embedding_error(scan.table(spark, sf_dir, "embeddings"), x[: WIDTH // 2], x[WIDTH // 2 :])
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


@named("SELECT event_type, user_id, count(value) AS n, round(avg(value), 6) AS mean, CASE WHEN count(value) > 1 THEN round(stddev_pop(value), 5) END AS std FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def replicate_summary(spark, sf_dir):
    out = quality.replicate_summary(scan.table(spark, sf_dir, "events"), ["event_type", "user_id"], "value")
    return out.select("event_type", "user_id", "n", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"))


@named(
    """WITH v AS (SELECT l_returnflag AS g, CAST(l_quantity AS BIGINT) AS size, avg(l_extendedprice / l_quantity) AS value FROM lineitem GROUP BY 1, 2),
t AS (SELECT *, last_value(value) OVER w AS z, count(*) OVER (PARTITION BY g) AS n FROM v WINDOW w AS (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
o AS (SELECT *, max(CAST(abs(value - z) > 400 AS INT)) OVER (PARTITION BY g ORDER BY size ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS off FROM t)
SELECT g, min(size) AS size FROM o WHERE off = 0 AND n > 1 GROUP BY g"""
)
def convergence_point(spark, sf_dir):
    v = scan.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").cast("bigint").alias("size")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    return quality.convergence_point(v, "g", "size", "value", 400.0)


@named("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 10 = 3 AS is_val FROM orders")
def positional_split(spark, sf_dir):
    return quality.positional_split(scan.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.9, 13)


@named(
    f"""WITH {_knn_sql('nn', '{}.embedding', 1000000)}, {_knn_sql('low', '{}.embedding[1:16]', 1000000)}, p AS (SELECT nn.distance AS high, low.distance AS low FROM nn JOIN low USING (q, id) WHERE nn.place <= 100),
r AS (SELECT *, rank() OVER (ORDER BY high) + (count(*) OVER (PARTITION BY high) - 1) / 2 AS rh, rank() OVER (ORDER BY low) + (count(*) OVER (PARTITION BY low) - 1) / 2 AS rl FROM p)
SELECT round(corr(high, low), 6) AS pearson, round(corr(rh, rl), 6) AS spearman FROM r"""
)
def distance_correlation(spark, sf_dir):
    """Of the 100 nearest rows of each query, distances in all and in the first 16 dimensions."""
    e = scan.table(spark, sf_dir, "embeddings")
    near = _knn(spark, sf_dir, 100)
    v = e.select("vec_id", F.slice("embedding", 1, 16).cast("array<double>").alias("v"))
    met = near.join(v.select(F.col("vec_id").alias("q"), F.col("v").alias("a")), "q").join(v.select(F.col("vec_id").alias("id"), F.col("v").alias("b")), "id")
    low = F.round(F.sqrt(F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), 6)
    out = quality.pair_distance_correlation(met.select(F.col("distance").alias("high"), low.alias("low")), "high", "low")
    return out.select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


@named(f"{_W}, f AS (SELECT cluster_label, count(*) AS size, avg(cluster_probability - 5) AS score FROM fm WHERE cluster_label >= 0 GROUP BY 1) SELECT round(sum(score * size) / sum(size), 6) AS weighted, round(avg(CAST(score < 0 AS INT)), 6) AS negative_share FROM f")
def score_reweighting(spark, sf_dir):
    f = featuremap(spark, sf_dir).where("cluster_label >= 0")
    sizes, scores = f.groupBy("cluster_label").agg(F.count("*").alias("size")), f.groupBy("cluster_label").agg(F.avg(F.col("cluster_probability") - 5).alias("score"))
    out = quality.reweighted_mean(scores, sizes, "cluster_label", "score")
    return out.select(F.round("weighted", 6).alias("weighted"), F.round("negative_share", 6).alias("negative_share"))
