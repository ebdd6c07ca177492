"""Ranked deduplication to one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCUS = ["CHROM", "POS", "REF", "ALT"]
COHORT_QUALITY = ["QUAL", "MAPQ", "DP", "RAW_VAF"]
SINGLE_QUALITY = ["SNVQ", *COHORT_QUALITY]


def ranked_dedup(
    df: DataFrame,
    quality: list[str],
    keys: list[str] | None = None,
    ties: list[str] | None = None,
    count: str | None = "locus_reads",
) -> DataFrame:
    """The best row of each key: quality descending, then ties ascending, nulls last in both; with the key's row count.

    Without all key columns nothing is deduplicated. Best row and count are one aggregation, in part before the only
    shuffle, so rows that can't win don't travel and a key that many rows share isn't ranked in one task. Quality
    columns are numbers.
    """
    keys = LOCUS if keys is None else keys
    if any(k not in df.columns for k in keys):
        return df
    kinds = dict(df.dtypes)
    ties = [c for c in dict.fromkeys(ties or df.columns) if c in df.columns]
    order = [x for c in quality if c in df.columns for x in (F.col(c).isNull(), *_descending(c, kinds[c]))]
    order += [x for c in ties for x in (F.col(c).isNull(), F.col(c))]
    first = F.min_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(order)]))
    best = df.groupBy(*keys).agg(first.alias("_row"), F.count("*").cast("int").alias("_n"))
    out = best.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns], "_n")
    return out.drop("_n") if count is None else out.withColumnRenamed("_n", count)


def _descending(column: str, kind: str) -> list[Column]:
    """What sorts ascending as a column of numbers does descending, NaN first."""
    c = F.col(column)
    if kind in ("float", "double"):
        return [~F.isnan(c), -c]
    return [-c] if kind.startswith("decimal") else [F.bitwise_not(c)]  # of integers it has no overflow


def uniqueness(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, distinct key tuples (nulls count as values), and whether they are equal."""
    each = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"))
    return total.select("n_rows", "n_keys", (F.col("n_rows") == F.col("n_keys")).alias("is_unique"))


def maximum_check(kept: DataFrame, source: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: keys checked, and keys whose kept value isn't the greatest in the source."""
    best = source.groupBy(*keys).agg(F.max(value).alias("best"))
    met = kept.select(*keys, F.col(value).alias("kept")).join(best, keys)
    return met.agg(F.count("*").alias("n_checked"), F.count_if(~F.col("kept").eqNullSafe(F.col("best"))).alias("n_wrong"))
