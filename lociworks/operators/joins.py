"""Joining results back to source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import LOCUS
from .ranks import placed, quantiles


def attach(source: DataFrame, assigned: DataFrame, key: str | list[str], how: str = "left") -> DataFrame:
    """Source rows with their assignments. A row without one has nulls, which isn't the same as noise."""
    return source.join(assigned, key, how)


def reconcile(attached: DataFrame, assigned: DataFrame, label: str = "cluster_label") -> DataFrame:
    """One row: attached labels, assigned rows, OK or FAILED."""
    one = attached.agg(F.count(label).alias("n_attached")).withColumn("n_assigned", assigned.agg(F.count("*")).scalar())
    return one.withColumn("status", F.when(F.col("n_attached") == F.col("n_assigned"), "OK").otherwise("FAILED"))


def join_keys(left: DataFrame, right: DataFrame, forced: str | None = None) -> list[str]:
    """row_index if both have it, else the locus; a forced choice must be there."""
    both = set(left.columns) & set(right.columns)
    for name, keys in (("row_index", ["row_index"]), ("locus", LOCUS)):
        if forced in (None, name) and both >= set(keys):
            return keys
    raise ValueError("no key that both sides have")


def override(predicted: DataFrame, fit: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Predicted rows, with the fit's values for rows that it has."""
    own = fit.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_fit"))
    met = predicted.join(own, predicted[key] == own["_key"], "left")
    return met.select(*[F.when(F.col("_fit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in predicted.columns])


def held_rows(rows: DataFrame, fit: DataFrame, key: str) -> DataFrame:
    return rows.join(fit, key, "left_anti")


def assignment_summary(df: DataFrame, key: str, label: str = "cluster_label") -> DataFrame:
    """One row about an assignment table."""
    one = df.agg(
        F.count("*").alias("n_rows"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.max(label).alias("max_label"),
        F.count_if(F.col(label) < 0).alias("noise"),
        F.count_distinct(label).alias("labels"),
    )
    return one.withColumn("clusters_present", F.col("labels") - F.when(F.col("noise") > 0, 1).otherwise(0)).drop("labels")


def cluster_profile(df: DataFrame, value: str, label: str = "cluster_label") -> DataFrame:
    """(label, size, mean, median) of each cluster without noise."""
    own = df.where(F.col(label) >= 0)
    means = own.groupBy(label).agg(F.count("*").alias("size"), F.avg(value).alias("mean"))
    return means.join(quantiles(own, [label], value, {"median": 0.5}).drop("n"), label, "left")


def positional(rows: DataFrame, number: str, labels: DataFrame, at: str) -> DataFrame:
    """rows joined to labels by position: the first label to the row of the least number, and so on. As many of each, or it is an error."""
    n, m = rows.count(), labels.count()
    if n != m:
        raise ValueError(f"{n} rows, {m} labels")
    return placed(rows, [number], name=at).join(labels, at)


def dense_index(df: DataFrame, order: list[str], name: str = "row_index") -> DataFrame:
    """df with a running number from 0 in a stable order."""
    return placed(df, order, name=name)


def subset_positions(everything: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, position) of wanted keys among all sorted ones; a key that isn't there has a null position."""
    return wanted.select(key).distinct().join(placed(everything.select(key).distinct(), [key], name="position"), key, "left")


def match_names(files: DataFrame, file: str, folders: DataFrame, folder: str, suffix: str) -> DataFrame:
    """files with the folder of the same stem, else of the stem without a suffix."""
    own = folders.select(F.col(folder).alias("_whole")), folders.select(F.col(folder).alias("_short"))
    short = F.regexp_replace(F.col(file), f"{suffix}$", "")
    met = files.join(own[0], F.col(file) == F.col("_whole"), "left").join(own[1], short == F.col("_short"), "left")
    return met.withColumn("folder", F.coalesce("_whole", "_short")).drop("_whole", "_short")


def label_counts(source: DataFrame, labels: DataFrame, key: list[str], label: str, where: Column, kept: Column) -> DataFrame:
    """(label, n): source rows that pass a filter, joined to their labels, of which a predicate keeps some."""
    return source.where(where).join(labels, key).where(kept).groupBy(label).agg(F.count("*").alias("n"))


def with_stats(stats: DataFrame, activities: DataFrame, fits: DataFrame, label: str, sample: str) -> DataFrame:
    """Cluster statistics with activities and, by cluster and sample, with fit statistics; all statistics stay."""
    return stats.join(activities, label, "left").join(fits, [label, sample], "left")
