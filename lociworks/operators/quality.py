"""Cluster validity, replicate summaries and convergence, as plans over grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed, small_side
from .ranks import placed, quantiles, value_ranks


def _centred(df: DataFrame, label: str, dims: list[Column]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with their dimensions, and one row of centroid and size per cluster."""
    names = [f"x{i}" for i in range(len(dims))]
    rows = df.select(F.col(label).alias("k"), *[d.cast("double").alias(n) for d, n in zip(dims, names)]).where("k IS NOT NULL")
    return rows, rows.groupBy("k").agg(F.count("*").alias("size"), *[F.avg(n).alias(f"c_{n}") for n in names]), names


def _distance(a: list[Column], b: list[Column]) -> Column:
    out = F.lit(0.0)
    for x, y in zip(a, b):
        out = out + (x - y) * (x - y)
    return F.sqrt(out)


def davies_bouldin(df: DataFrame, label: str, dims: list[Column]) -> DataFrame:
    """One row: the mean over clusters of the worst ratio of scatter to separation. Pairs are of clusters, not rows."""
    rows, centres, names = _centred(df, label, dims)
    scatter = rows.join(small_side(centres), "k").groupBy("k").agg(F.avg(_distance([F.col(n) for n in names], [F.col(f"c_{n}") for n in names])).alias("s"))
    c = centres.join(scatter, "k")
    a, b = c.select(*[F.col(x).alias(f"a_{x}") for x in c.columns]), c.select(*[F.col(x).alias(f"b_{x}") for x in c.columns])
    apart = _distance([F.col(f"a_c_{n}") for n in names], [F.col(f"b_c_{n}") for n in names])
    worst = a.join(b, F.col("a_k") != F.col("b_k")).groupBy("a_k").agg(F.max(F.try_divide(F.col("a_s") + F.col("b_s"), apart)).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz(df: DataFrame, label: str, dims: list[Column]) -> DataFrame:
    """One row: between-cluster over within-cluster dispersion, each by its degrees of freedom; from sums of squares alone."""
    rows, _, names = _centred(df, label, dims)
    per = rows.groupBy("k").agg(
        F.count("*").cast("double").alias("n"),
        *[F.avg(n).alias(f"m_{n}") for n in names],
        *[F.var_pop(n).alias(f"v_{n}") for n in names],
    )
    total = sum((F.col(f"v_{n}") for n in names[1:]), F.col(f"v_{names[0]}")) * F.col("n")
    means = per.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("groups"),
        F.sum(total).alias("within"),
        *[(F.sum(F.col(f"m_{n}") * F.col("n")) / F.sum("n")).alias(f"g_{n}") for n in names],
    )
    apart = sum(((F.col(f"m_{n}") - F.col(f"g_{n}")) ** 2 for n in names[1:]), (F.col(f"m_{names[0]}") - F.col(f"g_{names[0]}")) ** 2)
    between = per.join(F.broadcast(means)).agg(F.sum(F.col("n") * apart).alias("between"), *[F.first(c).alias(c) for c in ("rows", "groups", "within")])  # one row of means
    return between.select(F.try_divide(
        F.col("between") * (F.col("rows") - F.col("groups")),
        F.col("within") * (F.col("groups") - 1),
    ).alias("calinski_harabasz"))


def reweighted_mean(scores: DataFrame, sizes: DataFrame, label: str, score: str) -> DataFrame:
    """One row: cluster scores weighted by true sizes over all rows, and the share of negative ones."""
    met = scores.join(sizes, label)
    return met.agg((F.sum(F.col(score) * F.col("size")) / F.sum("size")).alias("weighted"), F.avg((F.col(score) < 0).cast("double")).alias("negative_share"))


def embedding_error(df: DataFrame, a: list[Column], b: list[Column]) -> DataFrame:
    """One row: mean, median and 95th percentile of row distances, in units of the pooled deviation of a."""
    pooled = F.lit(0.0)
    for c in a:
        pooled = pooled + F.var_pop(c.cast("double"))
    unit = df.agg(F.sqrt(pooled / len(a)).alias("u")).scalar()
    d = _distance([c.cast("double") for c in a], [c.cast("double") for c in b]) / unit
    each = df.select(d.alias("d"))
    return each.agg(F.avg("d").alias("mean")).join(quantiles(each, [], "d", {"median": 0.5, "p95": 0.95}).drop("n"), how="cross")  # one row each


def replicate_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, std): nulls and NaNs left out; population deviation, null for a single value."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    return ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.when(F.count("*") > 1, F.stddev_pop(value)).alias("std"))


def convergence_point(df: DataFrame, by: str, size: str, value: str, tolerance: float) -> DataFrame:
    """(by, size): the least size from which on all values lie within a tolerance of the last; two or more values are needed."""
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    tail = Window.partitionBy(by).orderBy(size).rowsBetween(0, Window.unboundedFollowing)
    last = ok.withColumn("_last", F.last(value).over(tail)).withColumn(
        "_off",
        F.max((F.abs(F.col(value) - F.col("_last")) > tolerance).cast("int")).over(tail),
    ).withColumn("_n", F.count("*").over(Window.partitionBy(by)))
    return last.where("_off = 0 AND _n > 1").groupBy(by).agg(F.min(size).alias(size))


def positional_split(df: DataFrame, order: str, fraction: float, seed: int) -> DataFrame:
    """df with is_val by position among its rows: every d-th, d = round(1 / (1 - fraction)).

    Positions are counted in two steps over ranges of the order, so no task ranks all rows. The ranges come from a
    sample, so rows with their range are checkpointed: both steps see the same ones.
    """
    d = round(1 / (1 - fraction))
    return placed(df, [order]).withColumn("is_val", F.pmod(F.col("_before"), F.lit(d)) == seed % d).drop("_before")


def pair_distance_correlation(pairs: DataFrame, high: str, low: str) -> DataFrame:
    """One row: Pearson correlation of two distance columns, and Spearman's, as Pearson of average ranks among distinct values."""
    pairs = checkpointed(pairs)  # they are read three times

    def ranks(column: str) -> DataFrame:
        return value_ranks(pairs, [], column).select(column, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r_{column}"))

    met = pairs.join(ranks(high), high).join(ranks(low), low)
    return met.agg(F.corr(high, low).alias("pearson"), F.corr(f"r_{high}", f"r_{low}").alias("spearman"))
