"""A feature map, one row per single-read observation, derived from lineitem in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .scan import table

CANONICAL = "st = 'MIXED' AND et = 'MIXED' AND FILT = 1"


def _select(text: str) -> str:
    return f"""
SELECT l_returnflag AS sample, concat('chr', CAST(1 + l_suppkey % 5 AS {text})) AS CHROM, l_partkey % 100 AS POS,
  substr('ACGTN', CAST(1 + l_orderkey % 5 AS int), 1) AS REF, substr('ACGT', CAST(1 + l_linenumber % 4 AS int), 1) AS ALT,
  substr('ACGT', CAST(1 + l_partkey % 4 AS int), 1) AS X_PREV1, substr('ACGT', CAST(1 + l_suppkey % 4 AS int), 1) AS X_NEXT1,
  l_extendedprice AS SNVQ, l_quantity AS QUAL, CAST(l_linenumber AS bigint) AS DP,
  nullif(l_tax, CAST(0.02 AS double)) AS MAPQ, nullif(l_discount, CAST(0.05 AS double)) AS RAW_VAF,
  CASE l_returnflag WHEN 'N' THEN 'PLUS' ELSE 'MIXED' END AS st, CASE l_linestatus WHEN 'O' THEN 'MINUS' ELSE 'MIXED' END AS et,
  CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS FILT,
  CAST(l_partkey % 13 - 1 AS int) AS cluster_label, CAST(l_suppkey % 7 - 1 AS int) AS other_label, l_discount * 10 AS cluster_probability,
  l_orderkey AS okey, l_partkey AS pkey, l_suppkey AS skey
FROM """


def featuremap(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The feature map over the table of a folder, or over the given rows, which may be a stream."""
    return spark.sql(_select("string") + "{lineitem}", lineitem=table(spark, sf_dir, "lineitem") if lineitem is None else lineitem)


#: The same as a common table expression for DuckDB.
FM_SQL = f"fm AS ({_select('varchar')} lineitem)"
