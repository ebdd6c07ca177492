"""A stored index of samples, cells of a sweep in JSON files, and row counts from footers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "view_name string, source string, assignments string, labelled_rows long, noise_pct double, row_filter string, sample string"


def put_index(rows: DataFrame, path: str) -> None:
    """Writes index rows, one partition a sample; samples that rows name are replaced, all others stay as they are."""
    from pyspark.sql.types import StructType

    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(INDEX).fields])
    typed.repartition("sample").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


#: What cells may say of themselves; parts and numbers that a file lacks are null.
METRICS = (
    "label string, error string, cohort_n_clusters long, cohort_noise_fraction double, cluster_backend string, "
    "cell struct<fit_rows: long, min_cluster_size: long, min_samples: long, cluster_selection_method: string, cluster_selection_epsilon: double>, "
    "spectrum struct<top_channel_share_median: double, frac_above_05: double, frac_above_08: double>, "
    "geometry struct<dbcv: double, connectivity_mean: double, prob_mean: double, persistence_mean: double, dbcv_backend: string>, "
    "assignment struct<cosine_mean: double, cosine_weighted_mean: double, l1_pct_mean: double, l2_pct_mean: double>"
)


def read_cells(spark: SparkSession, pattern: str) -> DataFrame:
    """(cell, status, metrics) of one JSON file for each cell: its folder is its name. Broken files are rows too; an empty file is none.

    status: BROKEN if the file is no JSON object, ERROR if it tells of one, else OK. Fields that are unknown are left out.
    """
    text = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)/[^/]+$", 1).alias("cell"), "value")
    parsed = text.withColumn("m", F.from_json("value", f"{METRICS}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    broken = F.col("m").isNull() | F.col("m._broken").isNotNull() | ~F.coalesce(F.trim("value").startswith("{"), F.lit(False))
    status = F.when(broken, "BROKEN").when(F.col("m.error").isNotNull(), "ERROR").otherwise("OK")
    return parsed.select("cell", status.alias("status"), F.when(status == "OK", F.col("m").dropFields("_broken")).alias("metrics"))


def ranked_cells(cells: DataFrame) -> DataFrame:
    """Finished cells as a table for ranking: one column for each number, absent backends as "?"."""
    m = lambda name: F.col(f"metrics.{name}")
    return cells.where("status = 'OK'").select(
        "cell",
        m("cell.fit_rows").alias("fit_rows"),
        m("cell.min_cluster_size").alias("mcs"),
        m("cell.min_samples").alias("ms"),
        F.coalesce(m("cohort_n_clusters"), F.lit(0)).alias("n_clusters"),
        F.round(F.coalesce(m("cohort_noise_fraction"), F.lit(0.0)) * 100, 2).alias("noise_pct"),
        F.coalesce(m("cluster_backend"), F.lit("?")).alias("backend"),
        F.round(m("spectrum.top_channel_share_median"), 3).alias("top_chan"),
        m("geometry.dbcv").alias("dbcv"),
        F.round(m("assignment.cosine_mean"), 4).alias("cos_mean"),
    )


def completeness(planned: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, status) of all cells that were planned: INCOMPLETE where there is no file, which is written last."""
    return planned.select("cell").distinct().join(cells.select("cell", "status"), "cell", "left").select("cell", F.coalesce("status", F.lit("INCOMPLETE")).alias("status"))


def write_cells(cells: DataFrame, cell: Column, text: Column, path: str) -> None:
    """One file in a folder of its own for each cell."""
    cells.select(cell.alias("cell"), text.alias("value")).repartition("cell").write.mode("overwrite").partitionBy("cell").text(path)


def footer_count(spark: SparkSession, path: str) -> DataFrame:
    """One row n: the rows of a Parquet table, added up from its footers; no column is read."""
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session.read.parquet(path).agg(F.count("*").alias("n"))
