"""Scans, filters, deduplication, joins, statistics, spectra and histograms over the derived feature map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode, filters, spectrum
from ..operators import compare, dedup, histograms, joins, moments, spectra
from ..sources import scan
from ..sources.checkpoint import checkpointed
from ..sources.featuremap import CANONICAL, FM_SQL, featuremap
from .named import named

FEATURES = ["SNVQ", "QUAL", "MAPQ", "RAW_VAF"]
_DEDUP_COLUMNS = ["CHROM", "POS", "REF", "ALT", "X_PREV1", "X_NEXT1", "QUAL", "MAPQ", "DP", "RAW_VAF", "SNVQ", "sample", "pkey", "okey", "skey"]
_W = f"WITH {FM_SQL}"
_TIES = ", ".join(f"{c} ASC NULLS LAST" for c in _DEDUP_COLUMNS)


def _ranked_sql(quality: list[str]) -> str:
    order = ", ".join(f"{c} DESC NULLS LAST" for c in quality)
    return f"""{_W} SELECT {', '.join(_DEDUP_COLUMNS)}, locus_reads FROM (
  SELECT *, row_number() OVER (PARTITION BY CHROM, POS, REF, ALT ORDER BY {order}, {_TIES}) AS r,
    CAST(count(*) OVER (PARTITION BY CHROM, POS, REF, ALT) AS INT) AS locus_reads
  FROM fm WHERE {CANONICAL}) WHERE r = 1"""


@named(f"{_W} SELECT CHROM, POS, REF, ALT, QUAL FROM fm WHERE {CANONICAL}")
def scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(featuremap(spark, sf_dir), ["CHROM", "POS", "absent", "REF", "ALT", "QUAL", "POS"], CANONICAL)


@named(f"{_W} SELECT count(*) AS n FROM fm WHERE {CANONICAL}")
def row_count(spark, sf_dir):
    return featuremap(spark, sf_dir).where(CANONICAL).agg(F.count("*").alias("n"))


@named("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_returnflag <> 'N' AND l_shipdate IS NOT NULL")
def restricted_filter(spark, sf_dir):
    df = scan.table(spark, sf_dir, "lineitem")
    return df.where(filters.compile_filter(df, "l_quantity >= 30 AND l_returnflag <> 'N' AND \"l_shipdate\" IS NOT NULL")).select("l_orderkey", "l_quantity")


@named(f"{_W} SELECT DISTINCT CHROM FROM fm WHERE CHROM IS NOT NULL AND {CANONICAL}")
def partition_discovery(spark, sf_dir):
    return featuremap(spark, sf_dir).where(CANONICAL).select("CHROM").where("CHROM IS NOT NULL").distinct()


@named(f"{_W} SELECT {', '.join(f'count({c}) AS {c}' for c in FEATURES)} FROM fm")
def nonnull_profile(spark, sf_dir):
    return moments.nonnull_profile(featuremap(spark, sf_dir), FEATURES)


def _moments_sql() -> str:
    return "m AS (" + " UNION ALL ".join(f"SELECT sample, '{c}' AS feature, count(*) AS n_rows, count({c}) AS n, coalesce(avg({c}), 0) AS mean, coalesce(var_samp({c}), 0) * greatest(count({c}) - 1, 0) AS m2 FROM fm GROUP BY sample" for c in FEATURES) + ")"


@named(f"{_W}, {_moments_sql()} SELECT sample, feature, n_rows, n, round(mean, 6) AS mean, round(m2 / n, 4) AS variance FROM m")
def fused_moments(spark, sf_dir):
    m = moments.fused_moments(featuremap(spark, sf_dir), "sample", FEATURES)
    return m.select("sample", "feature", "n_rows", "n", F.round("mean", 6).alias("mean"), F.round(F.col("m2") / F.col("n"), 4).alias("variance"))


_MERGED = ", ".join(f"count({c}) AS n_{c}, avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in FEATURES)


@named(f"{_W}, w AS (SELECT {_MERGED} FROM fm) " + " UNION ALL ".join(f"SELECT '{c}' AS feature, n_{c} AS n, round(mean_{c}, 6) AS mean, round(std_{c}, 6) AS std FROM w" for c in FEATURES))
def moments_merge(spark, sf_dir):
    scaled = moments.standard_scale(moments.merge_moments(moments.fused_moments(featuremap(spark, sf_dir), "sample", FEATURES), "sample"))
    return scaled.select("feature", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


_SPARSE = {"EMPTY": "CASE WHEN QUAL < 0 THEN QUAL END", "IN_ONE": "CASE WHEN sample = 'R' THEN QUAL END"}


@named(f"{_W}, w AS (SELECT QUAL, {', '.join(f'{x} AS {c}' for c, x in _SPARSE.items())} FROM fm), u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n FROM w" for c in ("QUAL", *_SPARSE)) + ") SELECT feature, n FROM u WHERE n > 0")
def feature_drop(spark, sf_dir):
    """A feature without values in any sample goes, one that a single sample has stays."""
    df = featuremap(spark, sf_dir).withColumns({c: F.expr(x) for c, x in _SPARSE.items()})
    return moments.standard_scale(moments.merge_moments(moments.fused_moments(df, "sample", ["QUAL", *_SPARSE]), "sample")).select("feature", "n")


@named(_ranked_sql(dedup.COHORT_QUALITY))
def dedup_locus_cohort(spark, sf_dir):
    return dedup.ranked_dedup(featuremap(spark, sf_dir).where(CANONICAL).select(*_DEDUP_COLUMNS), dedup.COHORT_QUALITY, ties=_DEDUP_COLUMNS)


@named(_ranked_sql(dedup.SINGLE_QUALITY))
def dedup_locus_snvq(spark, sf_dir):
    return dedup.ranked_dedup(featuremap(spark, sf_dir).where(CANONICAL).select(*_DEDUP_COLUMNS), dedup.SINGLE_QUALITY, ties=_DEDUP_COLUMNS)


@named(f"{_W} SELECT count(DISTINCT (CHROM, POS, REF, ALT)) AS loci, count(*) AS reads, round(count(*) / count(DISTINCT (CHROM, POS, REF, ALT)), 6) AS ratio FROM fm WHERE {CANONICAL}")
def locus_reads(spark, sf_dir):
    out = dedup_locus_cohort(spark, sf_dir).agg(F.count("*").alias("loci"), F.sum("locus_reads").alias("reads"))
    return out.select("loci", "reads", F.round(F.col("reads") / F.col("loci"), 6).alias("ratio"))


@named(f"{_W} SELECT count(*) AS n_rows, count(DISTINCT (CHROM, POS, REF, ALT, MAPQ)) AS n_keys, count(*) = count(DISTINCT (CHROM, POS, REF, ALT, MAPQ)) AS is_unique FROM fm")
def verify_unique(spark, sf_dir):
    return dedup.uniqueness(featuremap(spark, sf_dir), [*dedup.LOCUS, "MAPQ"])


def _checked_sql(name: str, quality: list[str]) -> str:
    return f"""SELECT '{name}' AS kept_by, count(*) AS n_checked, count(*) FILTER (SNVQ IS DISTINCT FROM best) AS n_wrong FROM (SELECT SNVQ,
  row_number() OVER (PARTITION BY CHROM, POS, REF, ALT ORDER BY {", ".join(f"{c} DESC NULLS LAST" for c in quality)}, {_TIES}) AS r, max(SNVQ) OVER (PARTITION BY CHROM, POS, REF, ALT) AS best FROM fm WHERE {CANONICAL}) WHERE r = 1"""


@named(f"{_W} {_checked_sql('SNVQ', dedup.SINGLE_QUALITY)} UNION ALL {_checked_sql('QUAL', dedup.COHORT_QUALITY)}")
def verify_max(spark, sf_dir):
    """Rows kept by SNVQ all have their locus's best SNVQ; of those kept by QUAL many don't."""
    source = featuremap(spark, sf_dir).where(CANONICAL)
    check = lambda kept, name: dedup.maximum_check(kept, source, dedup.LOCUS, "SNVQ").select(F.lit(name).alias("kept_by"), "*")
    return check(dedup_locus_snvq(spark, sf_dir), "SNVQ").unionAll(check(dedup_locus_cohort(spark, sf_dir), "QUAL"))


_COMP = "CASE {0} WHEN 'A' THEN 'T' WHEN 'T' THEN 'A' WHEN 'C' THEN 'G' WHEN 'G' THEN 'C' END"


def _label_sql() -> str:
    c = {x: _COMP.format(x) for x in ("REF", "ALT", "X_PREV1", "X_NEXT1")}
    return f"""lab AS (SELECT *, CASE WHEN change IN {spectrum.SUBSTITUTIONS} THEN lft || '[' || change || ']' || rgt END AS channel FROM (
  SELECT *, CASE WHEN REF IN ('C', 'T') THEN REF || '>' || ALT ELSE {c['REF']} || '>' || {c['ALT']} END AS change,
    CASE WHEN REF IN ('C', 'T') THEN X_PREV1 ELSE {c['X_NEXT1']} END AS lft, CASE WHEN REF IN ('C', 'T') THEN X_NEXT1 ELSE {c['X_PREV1']} END AS rgt FROM fm))"""


_L = f"{_W}, {_label_sql()}"
_SPEC = f"{_L}, spec AS (SELECT cluster_label, channel, count(*) AS n FROM lab WHERE cluster_label >= 0 AND channel IS NOT NULL GROUP BY ALL)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return featuremap(spark, sf_dir).withColumn("channel", spectrum.canonical_label(c("REF"), c("ALT"), c("X_PREV1"), c("X_NEXT1")))


def spectrum_of(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    return spectra.counts_by_bases(featuremap(spark, sf_dir), **more)


@named(f"{_L} SELECT cluster_label, channel, count(*) AS n FROM lab GROUP BY ALL")
def sbs96_canonical(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("cluster_label", "channel").agg(F.count("*").alias("n"))


@named(f"{_L} SELECT CASE WHEN REF IN ('A','C','G','T') AND REF <> ALT THEN channel END AS channel, count(*) AS n FROM lab GROUP BY 1")
def sbs96_strict(spark, sf_dir):
    c = F.col
    return featuremap(spark, sf_dir).groupBy(spectrum.strict_label(F.lower(c("REF")), c("ALT"), c("X_PREV1"), c("X_NEXT1")).alias("channel")).agg(F.count("*").alias("n"))


@named(f"{_W} SELECT X_PREV1 || '[' || REF || '>' || ALT || ']' || X_NEXT1 AS label, count(*) AS n FROM fm GROUP BY 1")
def trinuc192(spark, sf_dir):
    c = F.col
    return featuremap(spark, sf_dir).groupBy(spectrum.strand_label(c("REF"), c("ALT"), c("X_PREV1"), c("X_NEXT1")).alias("label")).agg(F.count("*").alias("n"))


_CHANNELS = ", ".join(f"'{x}'" for x in spectrum.channels())


@named(f"{_SPEC} SELECT k.cluster_label, c.channel, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_label FROM spec) k CROSS JOIN (SELECT unnest([{_CHANNELS}]) AS channel) c LEFT JOIN spec USING (cluster_label, channel)")
def sbs96_matrix_long(spark, sf_dir):
    return spectra.matrix_long(spectrum_of(spark, sf_dir))


_LONG = f"{_SPEC}, lng AS (SELECT k.cluster_label, c.channel, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster_label FROM spec) k CROSS JOIN (SELECT unnest([{_CHANNELS}]) AS channel) c LEFT JOIN spec USING (cluster_label, channel))"


_WIDE = ", ".join(f"CAST(sum(n) FILTER (cluster_label = {k}) AS BIGINT) AS cluster_{k}" for k in range(12))


@named(f"{_LONG} SELECT channel, {_WIDE} FROM lng GROUP BY channel")
def sbs96_matrix_pivot(spark, sf_dir):
    return spectra.matrix_wide(spectra.matrix_long(spectrum_of(spark, sf_dir)))


@named(f"{_L} SELECT count(*) FILTER (cluster_label < 0) AS noise_rows, count(*) FILTER (channel IS NULL) AS unclassified_rows, count(*) AS n_rows FROM lab")
def side_counters(spark, sf_dir):
    return spectra.side_counters(labelled(spark, sf_dir))


_TOP = f"{_SPEC}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY n DESC, channel) AS place, CAST(sum(n) OVER (PARTITION BY cluster_label) AS BIGINT) AS total, sum(n) OVER (PARTITION BY cluster_label ORDER BY n DESC, channel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spec)"


@named(f"{_TOP} SELECT cluster_label, total, channel AS top_channel, round(n / total, 6) AS share FROM r WHERE place = 1")
def spectrum_top_channel(spark, sf_dir):
    return spectra.top_channel(spectrum_of(spark, sf_dir)).withColumn("share", F.round("share", 6))


@named(f"{_TOP} SELECT cluster_label, count(*) FILTER (coalesce(before, 0) / total < 0.9 - 1e-9) AS n_channels FROM r GROUP BY 1")
def channels_90(spark, sf_dir):
    return spectra.channels_for(checkpointed(spectrum_of(spark, sf_dir)))


@named(f"{_TOP} SELECT cluster_label, channel, n, place FROM r WHERE place <= 6")
def top_contexts(spark, sf_dir):
    return spectra.top_contexts(spectrum_of(spark, sf_dir), 6)


@named(
    f"""{_SPEC}, e AS (SELECT k.cluster_label AS k, c.channel, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.cluster_label) AS p
  FROM (SELECT DISTINCT cluster_label FROM spec) k CROSS JOIN (SELECT unnest([{_CHANNELS}]) AS channel) c LEFT JOIN spec USING (cluster_label, channel))
SELECT a.k AS a, b.k AS b, round(sum(a.p * b.p) / sqrt(sum(a.p * a.p) * sum(b.p * b.p)), 6) AS cosine, round(sum(abs(a.p - b.p)), 6) AS l1, round(sqrt(sum((a.p - b.p) * (a.p - b.p))), 6) AS l2
FROM e a JOIN e b ON a.channel = b.channel AND a.k < b.k GROUP BY 1, 2"""
)
def spectrum_pairwise(spark, sf_dir):
    return spectra.pairwise(checkpointed(spectrum_of(spark, sf_dir))).select("a", "b", *[F.round(c, 6).alias(c) for c in ("cosine", "l1", "l2")])


@named(f"{_L} SELECT change, lft || rgt AS context, CAST(least(99, greatest(0, floor((SNVQ - 1000) / 990))) AS INT) AS bin, count(*) AS n FROM lab WHERE channel IS NOT NULL GROUP BY 1, 2, 3")
def hist_1d(spark, sf_dir):
    """Quality by substitution and flanking bases."""
    channel = F.col("channel")
    own = labelled(spark, sf_dir).where(channel.isNotNull()).withColumns({"change": spectrum.substitution_of(channel), "context": F.concat(F.substring(channel, 1, 1), F.substring(channel, 7, 1))})
    return histograms.histogram(own, ["change", "context"], "SNVQ", 1000.0, 100000.0, 100)


@named(
    f"""{_W} SELECT CAST(least(15, greatest(0, floor((QUAL - 5) / 2.5))) AS INT) AS x_bin, CAST(least(15, greatest(0, floor((SNVQ - 5000) / 5000))) AS INT) AS y_bin, count(*) AS n,
  count(*) FILTER (NOT (QUAL BETWEEN 5 AND 45 AND SNVQ BETWEEN 5000 AND 85000)) AS clipped FROM fm GROUP BY 1, 2"""
)
def hist_2d(spark, sf_dir):
    return histograms.histogram_2d(featuremap(spark, sf_dir), "QUAL", "SNVQ", (5.0, 45.0, 5000.0, 85000.0), 16)


@named(f"{_W} SELECT round(quantile_cont(SNVQ, 0.005), 2) AS lo, round(quantile_cont(SNVQ, 0.995), 2) AS hi FROM fm")
def robust_extent(spark, sf_dir):
    return histograms.robust_extent(featuremap(spark, sf_dir), "SNVQ", 0.5).select(F.round("lo", 2).alias("lo"), F.round("hi", 2).alias("hi"))


@named(
    f"""{_W}, s AS (SELECT *, {CANONICAL} AS f1, REF IN ('A','C','G','T') AND REF <> ALT AS f2, SNVQ BETWEEN 20000 AND 60000 AS f3 FROM fm)
SELECT count(*) FILTER (f1) AS filtered, count(*) FILTER (f1 AND f2) AS valid, count(*) FILTER (f1 AND f2 AND f3) AS windowed, min(SNVQ) FILTER (f1 AND f2 AND f3) AS least, max(SNVQ) FILTER (f1 AND f2 AND f3) AS most FROM s"""
)
def funnel(spark, sf_dir):
    c = F.col
    return histograms.funnel(featuremap(spark, sf_dir), {"filtered": F.expr(CANONICAL), "valid": c("REF").isin("A", "C", "G", "T") & (c("REF") != c("ALT")), "windowed": c("SNVQ").between(20000, 60000)}, "SNVQ")


# results joined back to sources: orders are source rows, an assignment is a row per order of some customers

_ASSIGNED = "asg AS (SELECT o_orderkey AS row_index, CAST(o_custkey % 9 - 1 AS INT) AS cluster_label, o_totalprice AS x FROM orders WHERE o_orderstatus = 'F')"
_SOURCE = "src AS (SELECT o_orderkey AS row_index, o_custkey FROM orders)"


def _source(spark, sf_dir):
    return scan.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_index"), "o_custkey")


def _assigned(spark, sf_dir):
    o = scan.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.select(F.col("o_orderkey").alias("row_index"), (F.col("o_custkey") % 9 - 1).cast("int").alias("cluster_label"), F.col("o_totalprice").alias("x"))


@named(f"WITH {_SOURCE}, {_ASSIGNED} SELECT row_index, o_custkey, cluster_label, x FROM src LEFT JOIN asg USING (row_index)")
def attach_left(spark, sf_dir):
    s, a = _source(spark, sf_dir), _assigned(spark, sf_dir)
    return joins.attach(s, a, joins.join_keys(s, a))


@named(f"WITH {_SOURCE}, {_ASSIGNED} SELECT row_index, o_custkey, cluster_label, x FROM src JOIN asg USING (row_index)")
def attach_inner(spark, sf_dir):
    return joins.attach(_source(spark, sf_dir), _assigned(spark, sf_dir), "row_index", "inner")


_RECONCILED = "SELECT '{0}' AS source, count(*) FILTER (row_index IN (SELECT row_index FROM src WHERE {1})) AS n_attached, count(*) AS n_assigned, CASE WHEN count(*) FILTER (row_index IN (SELECT row_index FROM src WHERE {1})) = count(*) THEN 'OK' ELSE 'FAILED' END AS status FROM asg"


@named(f"WITH {_SOURCE}, {_ASSIGNED} {_RECONCILED.format('whole', 'true')} UNION ALL {_RECONCILED.format('lossy', 'row_index % 3 > 0')}")
def attach_reconcile(spark, sf_dir):
    """Assignments joined to their whole source, and to one that has lost rows."""
    a, s = _assigned(spark, sf_dir), _source(spark, sf_dir)
    told = lambda source, name: joins.reconcile(joins.attach(source, a, "row_index"), a).select(F.lit(name).alias("source"), "*")
    return told(s, "whole").unionAll(told(s.where("row_index % 3 > 0"), "lossy"))


@named(f"WITH {_ASSIGNED} SELECT row_index, x, cluster_label FROM asg WHERE cluster_label IS NOT NULL AND cluster_label >= 0")
def cluster_rows(spark, sf_dir):
    return _assigned(spark, sf_dir).where(filters.cluster_predicate()).select("row_index", "x", "cluster_label")


@named(f"WITH {_ASSIGNED} SELECT count(*) AS n_rows, min(row_index) AS min_key, max(row_index) AS max_key, max(cluster_label) AS max_label, count(*) FILTER (cluster_label < 0) AS noise, count(DISTINCT cluster_label) FILTER (cluster_label >= 0) AS clusters_present FROM asg")
def assignment_summary(spark, sf_dir):
    return joins.assignment_summary(_assigned(spark, sf_dir), "row_index")


@named(f"WITH {_ASSIGNED} SELECT row_index, CASE WHEN row_index % 10 = 0 THEN 99 ELSE cluster_label END AS cluster_label, x FROM asg")
def fit_override(spark, sf_dir):
    a = _assigned(spark, sf_dir)
    return joins.override(a, a.where("row_index % 10 = 0").withColumn("cluster_label", F.lit(99)), "row_index", ["cluster_label"])


@named(f"WITH {_SOURCE}, {_ASSIGNED} SELECT row_index, o_custkey FROM src WHERE row_index NOT IN (SELECT row_index FROM asg)")
def held_out_anti(spark, sf_dir):
    return joins.held_rows(_source(spark, sf_dir), _assigned(spark, sf_dir).select("row_index"), "row_index")


@named("SELECT CAST(n_name AS VARCHAR) AS name, n_regionkey AS region, 'nation' AS sample FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def all_samples_union(spark, sf_dir):
    n, r = scan.table(spark, sf_dir, "nation"), scan.table(spark, sf_dir, "region")
    return scan.union_by_name({"nation": n.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), "region": r.select(F.col("r_name").alias("name"))})


@named(f"{_W} SELECT cluster_label, count(*) AS size, round(avg(cluster_probability), 6) AS mean, round(median(cluster_probability), 6) AS median FROM fm WHERE cluster_label >= 0 GROUP BY 1")
def cluster_profile(spark, sf_dir):
    return joins.cluster_profile(featuremap(spark, sf_dir), "cluster_probability").select("cluster_label", "size", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@named(f"{_W}, c AS (SELECT cluster_label, count(*) AS n FROM fm GROUP BY 1) SELECT cluster_label, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM c")
def pct_of_total(spark, sf_dir):
    counts = featuremap(spark, sf_dir).groupBy("cluster_label").agg(F.count("*").alias("n"))
    return compare.percent_of_total(counts, "cluster_label").withColumn("percent", F.round("percent", 6))


_SIG = [f"s{k}" for k in range(4)]
_SIGS = ", ".join(f"count(*) FILTER (skey % 4 = {k}) AS s{k}" for k in range(4))


@named(
    f"""{_W}, a AS (SELECT cluster_label, {_SIGS} FROM fm GROUP BY 1)
SELECT *, CASE greatest(s0, s1, s2, s3) WHEN s0 THEN 's0' WHEN s1 THEN 's1' WHEN s2 THEN 's2' ELSE 's3' END AS dominant, greatest(s0, s1, s2, s3) AS dominant_count, round(greatest(s0, s1, s2, s3) / (s0 + s1 + s2 + s3), 6) AS dominant_share FROM a"""
)
def dominant_category(spark, sf_dir):
    wide = featuremap(spark, sf_dir).groupBy("cluster_label").agg(*[F.count_if(F.col("skey") % 4 == k).alias(f"s{k}") for k in range(4)])
    return spectra.dominant_category(wide, _SIG).withColumn("dominant_share", F.round("dominant_share", 6))


_REF_SPEC = encode.FeatureSpec("REF", "c", {"": 0, "A": 1, "C": 2, "G": 3, "T": 4})


@named(f"{_W} SELECT CASE REF WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 3 WHEN 'T' THEN 4 ELSE 0 END AS code, count(*) AS n FROM fm GROUP BY 1")
def encode_categorical(spark, sf_dir):
    return featuremap(spark, sf_dir).groupBy(encode.category_code(F.col("REF"), _REF_SPEC).alias("code")).agg(F.count("*").alias("n"))


@named(f"{_W} SELECT sample, round(sum(CAST(CASE WHEN MAPQ IS NULL THEN 0 ELSE (CAST(MAPQ AS FLOAT) - CAST(0.04 AS FLOAT)) / CAST(0.025 AS FLOAT) END AS DOUBLE)), 2) AS total, count(MAPQ) AS present FROM fm GROUP BY 1")
def standardise(spark, sf_dir):
    df = featuremap(spark, sf_dir).select("sample", encode.standardised(F.col("MAPQ"), 0.04, 0.025).alias("x"), encode.mask(F.col("MAPQ")).alias("m"))
    return df.groupBy("sample").agg(F.round(F.sum(F.col("x").cast("double")), 2).alias("total"), F.sum("m").cast("bigint").alias("present"))


_CONT = f"{_W}, t AS (SELECT cluster_label AS a, other_label AS b, count(*) AS n FROM fm GROUP BY ALL)"
_AGREE = f"""{_CONT}, ma AS (SELECT a, sum(n) AS n FROM t GROUP BY a), mb AS (SELECT b, sum(n) AS n FROM t GROUP BY b), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS n FROM t),
s AS (SELECT (SELECT n FROM tot) AS n, (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM t) AS both_in, (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM ma) AS in_a, (SELECT sum(CAST(n AS DOUBLE) * (n - 1) / 2) FROM mb) AS in_b,
  (SELECT -sum(ma.n / tot.n * ln(ma.n / tot.n)) FROM ma, tot) AS h_a, (SELECT -sum(mb.n / tot.n * ln(mb.n / tot.n)) FROM mb, tot) AS h_b,
  (SELECT sum(t.n / tot.n * (ln(t.n * tot.n) - ln(CAST(ma.n AS DOUBLE) * mb.n))) FROM t JOIN ma USING (a) JOIN mb USING (b), tot) AS mi, (SELECT sum(m) FROM (SELECT max(n) AS m FROM t GROUP BY a)) AS most)"""


@named(f"{_CONT} SELECT a, b, n FROM t")
def contingency(spark, sf_dir):
    return compare.contingency(featuremap(spark, sf_dir), "cluster_label", "other_label")


def _agreement(spark, sf_dir, *columns):
    one = compare.agreement(contingency(spark, sf_dir))
    return one.select(*[F.round(c, 8).alias(c) for c in columns])


@named(f"{_AGREE} SELECT round((both_in - in_a * in_b / (n * (n - 1) / 2)) / ((in_a + in_b) / 2 - in_a * in_b / (n * (n - 1) / 2)), 8) AS ari FROM s")
def ari(spark, sf_dir):
    return _agreement(spark, sf_dir, "ari")


@named(f"{_AGREE} SELECT round(mi, 8) AS mi, round(2 * mi / (h_a + h_b), 8) AS nmi, round(mi / h_a, 8) AS homogeneity, round(mi / h_b, 8) AS completeness FROM s")
def nmi(spark, sf_dir):
    return _agreement(spark, sf_dir, "mi", "nmi", "homogeneity", "completeness")


@named(f"{_AGREE} SELECT round(greatest(h_a - mi, 0) + greatest(h_b - mi, 0), 8) AS vi FROM s")
def vi(spark, sf_dir):
    return _agreement(spark, sf_dir, "vi")


@named(f"{_AGREE} SELECT round(most / n, 8) AS purity FROM s")
def purity(spark, sf_dir):
    return _agreement(spark, sf_dir, "purity")


@named(f"{_AGREE} SELECT round(both_in / (in_a + in_b - both_in), 8) AS pair_jaccard FROM s")
def pair_jaccard(spark, sf_dir):
    return _agreement(spark, sf_dir, "pair_jaccard")


_BEST = f"{_CONT}, o AS (SELECT * FROM t WHERE a >= 0 AND b >= 0), j AS (SELECT a, CAST(any_value(na) AS BIGINT) AS size, max(n / (na + nb - n)) AS jaccard FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM o) GROUP BY a)"


@named(f"{_BEST} SELECT a, size, round(jaccard, 8) AS jaccard FROM j")
def jaccard_best(spark, sf_dir):
    return compare.best_jaccard(contingency(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 8))


@named(f"{_BEST} SELECT round(avg(jaccard), 8) AS mean, round(median(jaccard), 8) AS median, round(quantile_cont(jaccard, 0.1), 8) AS p10, avg(CAST(jaccard >= 0.75 AS INT)) AS stable, avg(CAST(jaccard < 0.5 AS INT)) AS dissolved, sum(CASE WHEN jaccard >= 0.75 THEN size ELSE 0 END) / sum(size) AS stable_points FROM j")
def cluster_stability(spark, sf_dir):
    s = compare.stability(compare.best_jaccard(contingency(spark, sf_dir)))
    return s.select(*[F.round(c, 8).alias(c) for c in s.columns])


@named(f"{_W} SELECT count(*) AS n, round(avg(cluster_probability), 8) AS mean, round(median(cluster_probability), 8) AS median, round(quantile_cont(cluster_probability, 0.1), 8) AS p10, round(quantile_cont(cluster_probability, 0.9), 8) AS p90, round(avg(CAST(cluster_probability > 0.5 AS INT)), 8) AS over_50, round(avg(CAST(cluster_probability > 0.8 AS INT)), 8) AS over_80 FROM fm WHERE cluster_label >= 0")
def prob_summary(spark, sf_dir):
    s = compare.probability_summary(featuremap(spark, sf_dir), "cluster_label", "cluster_probability")
    return s.select("n", *[F.round(c, 8).alias(c) for c in s.columns[1:]])


@named(
    """WITH f AS (SELECT l_discount * 10 AS c, l_tax * l_quantity AS l2, l_quantity AS w FROM lineitem)
SELECT round(avg(c), 8) AS cosine_mean, round(median(c), 8) AS cosine_median, round(sum(c * w) / sum(w), 8) AS cosine_weighted, round(avg(100 * l2 / w), 6) AS l2_percent,
  count(*) FILTER (c > 0.7) AS over_70, count(*) FILTER (c > 0.8) AS over_80, round(sum(CASE WHEN c > 0.8 THEN w ELSE 0 END) / sum(w), 8) AS weight_over_80 FROM f"""
)
def fit_summary(spark, sf_dir):
    f = scan.table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("c"), (F.col("l_tax") * F.col("l_quantity")).alias("l2"), F.col("l_quantity").alias("w"))
    s = compare.fit_summary(f, "c", "l2", "w")
    digits = {"l2_percent": 6}
    return s.select(*[F.round(c, digits.get(c, 8)).alias(c) if not c.startswith("over") else F.col(c) for c in s.columns])
