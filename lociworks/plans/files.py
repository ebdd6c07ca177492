"""Several files in one scan, rows by their place in a file, sinks that are read back, manifests and catalogues."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import filters, spectrum
from ..operators import dedup, joins, moments, reports, spectra
from ..sources import catalogue, export, scan, shared
from ..sources.checkpoint import checkpointed, own_path
from ..sources.featuremap import CANONICAL, FM_SQL, featuremap
from ..streaming import spectrum_stream
from .named import named
from .relational import _LONG, _SPEC, labelled, spectrum_of
from .vectors import _STOP

_W = f"WITH {FM_SQL}"
_SAMPLES = ("A", "N", "R")


def _parts(spark, sf_dir):
    fm = featuremap(spark, sf_dir)
    return {f"{k}-1.featuremap": fm.where(F.col("sample") == k).drop("sample") for k in _SAMPLES}


@named("SELECT 'nation' AS sample, * FROM nation UNION ALL BY NAME SELECT 'region' AS sample, * FROM region")
def multi_file_scan(spark, sf_dir):
    return scan.multi_file(spark, [f"{sf_dir}/nation.parquet", f"{sf_dir}/region.parquet"])


def _surviving(spark, sf_dir):
    """Rows of orders that pass a filter, with their place in the file."""
    return scan.with_row_number(scan.table(spark, sf_dir, "orders")).where("o_orderstatus = 'F'")


_PLACED = "ord AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS file_row_number FROM orders), sur AS (SELECT *, row_number() OVER (ORDER BY file_row_number) - 1 AS row_index FROM ord WHERE o_orderstatus = 'F')"


@named(f"WITH {_PLACED} SELECT o_orderkey, file_row_number FROM sur")
def row_number_scan(spark, sf_dir):
    return _surviving(spark, sf_dir).select("o_orderkey", "file_row_number")


@named(f"WITH {_PLACED} SELECT row_index, o_orderkey, file_row_number FROM sur")
def row_number_rescan(spark, sf_dir):
    """A running number of the rows that survive a filter, in the order of the file."""
    return joins.dense_index(_surviving(spark, sf_dir).select("o_orderkey", "file_row_number"), ["file_row_number"])


@named(f"WITH {_PLACED} SELECT row_index, file_row_number, CAST(row_index * 7 % 5 - 1 AS INT) AS cluster_label FROM sur")
def positional_join(spark, sf_dir):
    """Labels that were kept by position alone, given back to the rows they belong to."""
    rows = _surviving(spark, sf_dir).select("file_row_number")
    # a label array as an earlier run would have left it: as many as rows, numbered from 0
    labels = joins.dense_index(rows, ["file_row_number"], "row_index").select("row_index", (F.col("row_index") * 7 % 5 - 1).cast("int").alias("cluster_label"))
    return joins.positional(rows, "file_row_number", labels, "row_index")


@named(f"{_LONG} SELECT channel, cluster_label, n FROM lng")
def tsv_round_trip(spark, sf_dir):
    """The spectrum matrix written as TSV and read back into rows; cluster ids come from the names of the columns."""
    path = own_path(spark, "matrix")
    export.write_tsv(spectra.matrix_wide(spectra.matrix_long(spectrum_of(spark, sf_dir))).withColumnRenamed("channel", "Type"), path)
    wide = scan.read_tsv(spark, path).withColumnRenamed("Type", "channel")
    long = wide.unpivot("channel", [c for c in wide.columns if c != "channel"], "name", "n")
    return long.select("channel", spectrum.trailing_integer(F.col("name")).cast("int").alias("cluster_label"), F.col("n").cast("bigint").alias("n"))


@named(f"{_SPEC} SELECT substr(channel, 3, 3) AS substitution, cluster_label, CAST(sum(n) AS BIGINT) AS n FROM spec GROUP BY 1, 2")
def substitution_counts(spark, sf_dir):
    counts = spectrum_of(spark, sf_dir)
    return counts.groupBy(spectrum.substitution_of(F.col("channel")).alias("substitution"), "cluster_label").agg(F.sum("n").alias("n"))


@named(f"{_W} SELECT sample, CHROM, count(*) AS n FROM fm WHERE {CANONICAL} GROUP BY 1, 2")
def partitioned_parquet(spark, sf_dir):
    """One folder for each chromosome, compressed with ZSTD, read back with the chromosome from the folder's name."""
    path = own_path(spark, "by-chrom")
    export.write_partitioned(featuremap(spark, sf_dir).where(CANONICAL), path, "CHROM")
    return spark.read.parquet(path).groupBy("sample", F.col("CHROM").cast("string").alias("CHROM")).agg(F.count("*").alias("n"))


@named(f"{_W} SELECT sample || '-1.featuremap' AS sample, count(*) AS n, count(QUAL) AS present FROM fm GROUP BY 1")
def concatenated(spark, sf_dir):
    """Parts with differing columns written as one table; row counts are reconciled on the way."""
    path, parts = own_path(spark, "all"), _parts(spark, sf_dir)
    parts = {k: df.drop("MAPQ") if k.startswith("N") else df for k, df in parts.items()}
    export.concatenate(parts, path)
    return spark.read.parquet(path).groupBy("sample").agg(F.count("*").alias("n"), F.count("QUAL").alias("present"))


def _manifest(spark, sf_dir):
    fm = featuremap(spark, sf_dir)
    rows = fm.groupBy("sample", "CHROM").agg(F.count("*").alias("rows"), F.count_if(F.col("cluster_label") < 0).alias("noise"), F.max("SNVQ").alias("extra"))
    return rows.withColumn("status", F.when(F.col("noise") * 13 > F.col("rows"), "NOISY").otherwise("OK"))


@named(f"{_W}, m AS (SELECT sample, CHROM, count(*) AS n, count(*) FILTER (cluster_label < 0) AS noise FROM fm GROUP BY 1, 2) SELECT CASE WHEN noise * 13 > n THEN 'NOISY' ELSE 'OK' END AS status, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(noise) AS BIGINT) AS noise FROM m GROUP BY 1")
def manifest_totals(spark, sf_dir):
    """A manifest written with a fixed list of columns, and its totals by status."""
    path = own_path(spark, "manifest")
    export.write_manifest(_manifest(spark, sf_dir), path, ["sample", "CHROM", "status", "rows", "noise"])
    return reports.manifest_totals(spark.read.csv(path, header=True, inferSchema=True)).select("status", "files", F.col("rows").cast("bigint").alias("rows"), F.col("noise").cast("bigint").alias("noise"))


@named(f"{_W}, m AS (SELECT sample, CHROM, count(*) AS n, count(*) FILTER (cluster_label < 0) AS noise FROM fm GROUP BY 1, 2) SELECT CASE WHEN noise * 13 > n THEN 'NOISY' ELSE 'OK' END AS status, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(noise) AS BIGINT) AS noise FROM m GROUP BY 1")
def json_manifest_totals(spark, sf_dir):
    """The same manifest as JSON lines."""
    path = own_path(spark, "manifest")
    export.write_manifest(_manifest(spark, sf_dir), path, ["sample", "CHROM", "status", "rows", "noise"], "json")
    return reports.manifest_totals(spark.read.schema("status string, rows long, noise long").json(path))


@named(f"{_W} SELECT sample || '_1' AS view_name, sample || '-1.featuremap' AS sample, count(*) FILTER (cluster_label IS NOT NULL) AS labelled_rows, round(100.0 * count(*) FILTER (cluster_label < 0) / count(*), 6) AS noise_pct FROM fm GROUP BY sample")
def view_catalogue(spark, sf_dir):
    """A view of each sample, and an index that is worked out through the views."""
    names = scan.create_views(_parts(spark, sf_dir))
    rows = [spark.table(v).select(F.lit(v).alias("view_name"), F.lit(s).alias("sample"), "cluster_label") for s, v in names.items()]
    each = rows[0].unionAll(rows[1]).unionAll(rows[2])
    return each.groupBy("view_name", "sample").agg(F.count("cluster_label").alias("labelled_rows"), F.round(100.0 * F.count_if(F.col("cluster_label") < 0) / F.count("*"), 6).alias("noise_pct"))


@named("SELECT 'nation' AS sample, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'region', count(*) FROM region")
def resolved_files(spark, sf_dir):
    """Rows of the files that some patterns name, each file once."""
    paths = scan.resolve_paths(spark, [f"{sf_dir}/{{nation,region}}.parquet", f"{sf_dir}/o*s.parquet", f"{sf_dir}/nat*.parquet"])
    return scan.multi_file(spark, paths).groupBy("sample").agg(F.count("*").alias("n"))


@named("SELECT l_orderkey, l_quantity AS odd FROM lineitem WHERE l_quantity >= 30 AND l_returnflag <> 'odd \"name\"' AND l_tax IS NOT NULL")
def quoted_filter(spark, sf_dir):
    """A filter over columns of odd names; only those that it names are kept beside the key, and a literal names none."""
    rows = scan.table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_quantity": "odd name", "l_tax": "ta\"x", "l_returnflag": "flag"})
    where = f"{filters.quoted('odd name')} >= 30 AND flag <> 'odd \"name\"' AND {filters.quoted('ta\"x')} IS NOT NULL"
    own = rows.select("l_orderkey", *[f"`{c}`" for c in filters.columns_in(rows, where)])
    return own.where(filters.compile_filter(own, where)).select("l_orderkey", F.col("odd name").alias("odd"))


@named("SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS keys FROM lineitem")
def dedup_fallback(spark, sf_dir):
    """A table without the columns of a locus keeps all its rows."""
    kept = dedup.ranked_dedup(scan.table(spark, sf_dir, "lineitem"), ["l_quantity"])
    return kept.agg(F.count("*").alias("n"), F.count_distinct("l_orderkey", "l_linenumber").alias("keys"))


@named(f"{_W} SELECT least(count(*), 70) AS n, least(count(*), 70) AS passing FROM fm WHERE {CANONICAL}")
def plain_limit(spark, sf_dir):
    """Any 70 rows of a filtered scan: how many there are, and how many pass the filter."""
    rows = scan.scan(featuremap(spark, sf_dir), ["sample", "st", "et", "FILT"], CANONICAL, limit=70)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr(CANONICAL)).alias("passing"))


@named(f"{_SPEC}, c AS (SELECT DISTINCT channel FROM lab) SELECT channel, CAST(coalesce(list_position([{', '.join(repr(x) for x in spectrum.channels())}], channel), 0) - 1 AS INT) AS place FROM c UNION ALL SELECT 'N[C>A]G', -1")
def channel_places(spark, sf_dir):
    """The place of each label that occurs among the 96 channels; -1 for unknown ones and for rows without a label."""
    own = labelled(spark, sf_dir).select("channel").distinct().unionAll(spark.range(1).select(F.lit("N[C>A]G")))
    return own.select("channel", spectrum.channel_index(F.col("channel")).alias("place"))


@named("SELECT s_name AS name, CASE WHEN regexp_matches(replace(s_name, '#', '_'), '^[0-9]') THEN 's_' ELSE '' END || regexp_replace(s_name, '[^0-9A-Za-z_]', '_', 'g') AS view_name, CAST(nullif(regexp_extract(s_name, '([0-9]+)$', 1), '') AS BIGINT) AS number FROM supplier")
def names_of_views(spark, sf_dir):
    s = scan.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_name").alias("name"), scan.view_name(F.col("s_name")).alias("view_name"), spectrum.trailing_integer(F.col("s_name")).alias("number"))


@named("SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey, CAST(NULL AS DOUBLE) AS absent FROM orders")
def cast_or_null(spark, sf_dir):
    o = scan.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scan.cast_or_null(o, "o_custkey", "int").alias("o_custkey"), scan.cast_or_null(o, "absent", "double").alias("absent"))


@named(f"{_W} SELECT cluster_label, count(*) AS n FROM fm WHERE cluster_label IN (-1, 2, 5) GROUP BY 1")
def cluster_list(spark, sf_dir):
    """An explicit list of clusters overrides the exclusion of noise."""
    return featuremap(spark, sf_dir).where(filters.cluster_predicate([-1, 2, 5], exclude_noise=True)).groupBy("cluster_label").agg(F.count("*").alias("n"))


@named(f"{_SPEC} SELECT cluster_label, channel, n FROM spec")
def streamed_spectrum(spark, sf_dir):
    """The spectrum counts as a stream leaves them that stops midway and goes on from its checkpoint when more files come."""
    source, out, state = (own_path(spark, name) for name in ("observations", "spectrum", "state"))
    rows = scan.table(spark, sf_dir, "lineitem")
    for half in (0, 1):
        rows.where(F.col("l_orderkey") % 2 == half).write.mode("append").parquet(source)
        stream = featuremap(spark, sf_dir, spark.readStream.schema(rows.schema).parquet(source))
        spectrum_stream.stream_spectrum(stream, out, state).awaitTermination()
    return spectrum_stream.latest(spark, out, ["cluster_label", "channel"])


@named(_STOP)
def early_stop_stream(spark, sf_dir):
    """Where training on each event type's daily mean value would stop, told by a stream that is started anew for each third of the days."""
    source, out, state = (own_path(spark, name) for name in ("epochs", "stops", "state"))
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long")
    daily = scan.table(spark, sf_dir, "events").groupBy("event_type", day.alias("epoch")).agg(F.avg("value").alias("loss"), F.lit(16).cast("long").alias("active"))
    daily = checkpointed(daily)
    last = daily.agg(F.coalesce(F.max("epoch"), F.lit(0))).first()[0]
    for third in range(3):
        daily.where(F.floor(F.col("epoch") * 3 / (last + 1)) == third).write.mode("append").parquet(source)
        stream = spark.readStream.schema(daily.schema).parquet(source)
        spectrum_stream.stream_early_stop(stream, "event_type", 1e-3, 3, out, state).awaitTermination()
    return spectrum_stream.latest(spark, out, ["event_type"]).withColumn("best", F.round("best", 9))


def _index_of(spark, sf_dir, where: str):
    fm = featuremap(spark, sf_dir).where(where)
    name = F.concat("sample", F.lit("-1"))
    rows = fm.groupBy("sample").agg(F.count("cluster_label").alias("labelled_rows"), F.round(100.0 * F.count_if(F.col("cluster_label") < 0) / F.count("*"), 6).alias("noise_pct"))
    paths = {"source": F.concat(name, F.lit(".featuremap.parquet")), "assignments": F.concat(name, F.lit(".clusters.parquet"))}
    return rows.withColumns({"view_name": scan.view_name(name), "row_filter": F.lit(where), **paths, "sample": name})


@named(
    f"""{_W}, r AS (SELECT sample || '-1' AS sample, w AS row_filter, count(cluster_label) AS labelled_rows, round(100.0 * count(*) FILTER (cluster_label < 0) / count(*), 6) AS noise_pct
  FROM fm, (SELECT unnest(['FILT = 1', 'QUAL > 20']) AS w) WHERE CASE w WHEN 'FILT = 1' THEN FILT = 1 AND sample <> 'N' ELSE QUAL > 20 AND sample = 'N' END GROUP BY ALL)
SELECT sample, replace(sample, '-', '_') AS view_name, sample || '.featuremap.parquet' AS source, sample || '.clusters.parquet' AS assignments, labelled_rows, noise_pct, row_filter FROM r"""
)
def stored_catalogue(spark, sf_dir):
    """An index of all samples that is stored, and one sample's rows put in again with another filter."""
    path = own_path(spark, "sample-index")
    catalogue.put_index(_index_of(spark, sf_dir, "FILT = 1"), path)
    catalogue.put_index(_index_of(spark, sf_dir, "QUAL > 20").where("sample = 'N-1'"), path)
    return catalogue.read_index(spark, path)


_TABLES = ("orders", "lineitem", "events", "documents", "conversations")


@named(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def footer_counts(spark, sf_dir):
    """Rows of some tables, from their footers."""
    each = [catalogue.footer_count(spark, f"{sf_dir}/{t}.parquet").first().n for t in _TABLES]  # one number each
    return spark.createDataFrame(list(zip(_TABLES, each)), "name string, n long")


def _swept(spark, sf_dir):
    """Cells of a sweep over orders, as files that a run left: some tell of an error, some are cut off, one is missing."""
    o = scan.table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 8).groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.round(F.max("o_totalprice"), 2).alias("top"))
    share = F.col("f") / F.col("n")
    spectrum = F.when(F.col("k") % 4 != 1, F.struct(share.alias("top_channel_share_median")))
    text = F.to_json(
        F.struct(
            F.concat(F.lit("cell"), "k").alias("label"),
            F.when(F.col("k") == 2, "out of memory").alias("error"),
            F.struct(F.col("n").alias("fit_rows"), (F.col("k") * 5).alias("min_cluster_size"), F.lit(5).alias("min_samples")).alias("cell"),
            F.when(F.col("k") != 4, F.col("f")).alias("cohort_n_clusters"),
            share.alias("cohort_noise_fraction"),
            F.when(F.col("k") % 3 == 0, "cpu").alias("cluster_backend"),
            spectrum.alias("spectrum"),
            F.struct((share - 0.5).alias("dbcv")).alias("geometry"),
            F.when(F.col("k") == 5, F.array(F.lit(1), F.lit(2))).alias("notes"),
        )
    )
    cut = F.when(F.col("k") == 6, F.substring(text, 1, 40)).otherwise(text)
    path = own_path(spark, "cells")
    catalogue.write_cells(o.where("k <> 7").withColumn("text", cut), F.concat(F.lit("c"), "k"), F.col("text"), path)
    return catalogue.read_cells(spark, f"{path}/*/part-*"), o.select(F.concat(F.lit("cell=c"), "k").alias("cell"))


@named(
    """WITH o AS (SELECT o_custkey % 8 AS k, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM orders GROUP BY 1), r AS (SELECT *, CASE WHEN k % 4 <> 1 THEN round(f / n, 3) END AS top_chan FROM o WHERE k NOT IN (2, 6, 7))
SELECT 'cell=c' || k AS cell, n AS fit_rows, k * 5 AS mcs, CAST(5 AS BIGINT) AS ms, CASE WHEN k = 4 THEN 0 ELSE f END AS n_clusters, round(100 * (f / n), 2) AS noise_pct, CASE WHEN k % 3 = 0 THEN 'cpu' ELSE '?' END AS backend, top_chan,
  round(f / n - 0.5, 6) AS dbcv, row_number() OVER (ORDER BY top_chan NULLS LAST, k) AS place FROM r"""
)
def ranked_json_cells(spark, sf_dir):
    """The ranking of finished cells, read from their JSON files; cells without the number that leads come last."""
    cells, _ = _swept(spark, sf_dir)
    ranked = reports.ranking(catalogue.ranked_cells(cells), [F.asc_nulls_last("top_chan"), F.col("cell")])
    return ranked.drop("cos_mean").withColumn("dbcv", F.round("dbcv", 6))


@named("SELECT 'cell=c' || k AS cell, CASE k WHEN 2 THEN 'ERROR' WHEN 6 THEN 'BROKEN' WHEN 7 THEN 'INCOMPLETE' ELSE 'OK' END AS status FROM (SELECT DISTINCT o_custkey % 8 AS k FROM orders)")
def json_cell_status(spark, sf_dir):
    """What has become of each cell that was planned, from its file or the lack of one."""
    cells, planned = _swept(spark, sf_dir)
    return catalogue.completeness(planned, cells)


@named(
    "WITH r AS (SELECT o_orderstatus AS s, o_totalprice AS x FROM orders WHERE o_orderkey % 7 > 0), t AS (SELECT unnest([false, true]) AS cached) SELECT s, cached, count(*) AS n_rows, count(x) AS n, round(avg(x), 4) AS mean, round(var_samp(x) * (count(x) - 1) / 1e6, 4) AS m2 FROM r, t GROUP BY ALL"
)
def cached_moments(spark, sf_dir):
    """Moments of files, worked out, and once more from the cache that lies beside them."""
    path = own_path(spark, "parts")
    scan.table(spark, sf_dir, "orders").write.partitionBy("o_orderstatus").parquet(path)
    parts = {f"{path}/o_orderstatus={r[0]}": r[0] for r in scan.table(spark, sf_dir, "orders").select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()}
    cache = moments.MomentCache(spark, own_path(spark, "moments"))
    runs = [moments.file_moments(spark, list(parts), "o_orderkey % 7 > 0", ["o_totalprice"], cache) for _ in range(2)]
    both = runs[0].unionAll(runs[1])
    name = F.regexp_extract("path", "o_orderstatus=([^/]*)$", 1)
    return both.select(name.alias("s"), "cached", "n_rows", "n", F.round("mean", 4).alias("mean"), F.round(F.col("m2") / 1e6, 4).alias("m2"))


@named("SELECT o_orderstatus AS s, CASE o_orderstatus WHEN 'F' THEN 'OK' WHEN 'O' THEN 'DRIFTED' ELSE 'MISSING' END AS status FROM (SELECT DISTINCT o_orderstatus FROM orders) UNION ALL SELECT 'unknown', 'NOFILE'")
def source_drift(spark, sf_dir):
    """Sources against the fingerprints that were taken of them: one stayed, one was written anew, the others went."""
    path, files = own_path(spark, "sources"), shared.Files(spark)
    orders = scan.table(spark, sf_dir, "orders")
    orders.repartition("o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    found = {re.search("o_orderstatus=([^/]*)/", f)[1]: f for f, _, _ in files.stats(path)}
    records = {s: shared.fingerprint(files, f) for s, f in found.items()}
    orders.where("o_orderstatus = 'O' AND o_orderkey % 2 = 0").repartition(1).write.parquet(f"{path}-new")
    for s, f in found.items():
        if s == "O":
            files.write(f, files.read(files.stats(f"{path}-new")[0][0]))
    gone = {s: f if s in "FO" else f"{f}.gone" for s, f in found.items()}
    rows = [(s, shared.fingerprint_status(files, records[s], f)) for s, f in gone.items()]
    return spark.createDataFrame([*rows, ("unknown", shared.fingerprint_status(files, None, next(iter(found.values()))))], "s string, status string")
