"""Agreement of two labelings, from their contingency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import quantiles


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): one row per pair of labels, added up before the shuffle."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def _marginals(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return table.groupBy("a").agg(F.sum("n").alias("n_a")), table.groupBy("b").agg(F.sum("n").alias("n_b"))


def _pairs(n: Column) -> Column:
    x = n.cast("double")
    return x * (x - 1) / F.lit(2.0)


def _entropy(n: Column, total: Column) -> Column:
    p = n.cast("double") / total
    return -F.sum(p * F.ln(p))


def agreement(table: DataFrame) -> DataFrame:
    """One row: n, ari, mi, h_a, h_b, nmi, homogeneity, completeness, vi, purity, pair_jaccard."""
    a, b = _marginals(table)
    total = table.agg(F.sum("n").cast("double").alias("n"), F.sum(_pairs(F.col("n"))).alias("both"))
    n = total.select("n").scalar()
    side_a = a.agg(F.sum(_pairs(F.col("n_a"))).alias("in_a"), _entropy(F.col("n_a"), n).alias("h_a"))
    side_b = b.agg(F.sum(_pairs(F.col("n_b"))).alias("in_b"), _entropy(F.col("n_b"), n).alias("h_b"))
    x = F.col("n").cast("double")
    mi = table.join(a, "a").join(b, "b").agg(F.sum(x / n * (F.ln(x * n) - F.ln(F.col("n_a").cast("double") * F.col("n_b")))).alias("mi"))
    most = table.groupBy("a").agg(F.max("n").alias("m")).agg(F.sum("m").alias("most"))
    more = {c: df.select(c).scalar() for df, names in ((side_a, ("in_a", "h_a")), (side_b, ("in_b", "h_b")), (mi, ("mi",)), (most, ("most",))) for c in names}
    one = total.withColumns(more)
    expected = F.col("in_a") * F.col("in_b") / _pairs(F.col("n"))
    top = (F.col("in_a") + F.col("in_b")) / 2
    ari = F.when(F.col("n") < 2, float("nan")).when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected))
    ratio = lambda h: F.when(F.col(h) == 0, 1.0).otherwise(F.col("mi") / F.col(h))
    return one.select(
        F.col("n").cast("long").alias("n"),
        ari.alias("ari"),
        "mi",
        "h_a",
        "h_b",
        F.when(F.col("h_a") + F.col("h_b") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).alias("nmi"),
        ratio("h_a").alias("homogeneity"),
        ratio("h_b").alias("completeness"),
        (F.greatest(F.col("h_a") - F.col("mi"), F.lit(0.0)) + F.greatest(F.col("h_b") - F.col("mi"), F.lit(0.0))).alias("vi"),
        (F.col("most") / F.col("n")).alias("purity"),
        (F.col("both") / (F.col("in_a") + F.col("in_b") - F.col("both"))).alias("pair_jaccard"),
    )


def best_jaccard(table: DataFrame) -> DataFrame:
    """(a, size, jaccard) of each cluster a with its best match, noise left out on both sides."""
    own = table.where("a >= 0 and b >= 0")
    a, b = _marginals(own)
    met = own.join(a, "a").join(b, "b").withColumn("jaccard", F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n")))
    return met.groupBy("a").agg(F.first("n_a").alias("size"), F.max("jaccard").alias("jaccard"))


def stability(best: DataFrame) -> DataFrame:
    """One row over best_jaccard(): mean, median, p10, and shares of stable (0.75 or more) and dissolved (under 0.5) clusters."""
    j, n = F.col("jaccard"), F.col("size").cast("double")
    return best.agg(
        F.avg(j).alias("mean"),
        F.median(j).alias("median"),
        F.percentile(j, F.lit(0.1)).alias("p10"),
        F.avg((j >= 0.75).cast("double")).alias("stable"),
        F.avg((j < 0.5).cast("double")).alias("dissolved"),
        (F.sum(F.when(j >= 0.75, n).otherwise(0.0)) / F.sum(n)).alias("stable_points"),
    )


def percent_of_total(counts: DataFrame, by: str) -> DataFrame:
    """Counts with their percentage of all; the frame is already grouped, so one small window is enough."""
    return counts.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def probability_summary(df: DataFrame, label: str, value: str) -> DataFrame:
    """One row over labelled rows: n, mean, median, p10, p90, shares over 0.5 and 0.8."""
    own = df.where(F.col(label) >= 0)
    one = own.agg(
        F.count("*").alias("n"),
        F.avg(value).alias("mean"),
        F.avg((F.col(value) > 0.5).cast("double")).alias("over_50"),
        F.avg((F.col(value) > 0.8).cast("double")).alias("over_80"),
    )
    at = quantiles(own, [], value, {"median": 0.5, "p10": 0.1, "p90": 0.9}).drop("n")
    return one.join(at, how="cross").select("n", "mean", "median", "p10", "p90", "over_50", "over_80")  # one row each


def fit_summary(df: DataFrame, cosine: str, l2: str, weight: str) -> DataFrame:
    """One row over fits: mean, median and weighted mean of the cosine, rebased L2, shares above 0.7 and 0.8."""
    w, c = F.col(weight).cast("double"), F.col(cosine)
    total = F.sum(w)
    return df.where(c.isNotNull() & ~F.isnan(c)).agg(
        F.avg(c).alias("cosine_mean"),
        F.median(c).alias("cosine_median"),
        F.when(total == 0, float("nan")).otherwise(F.sum(c * w) / total).alias("cosine_weighted"),
        F.avg(F.when(w > 0, 100 * F.col(l2) / w)).alias("l2_percent"),
        F.count_if(c > 0.7).alias("over_70"),
        F.count_if(c > 0.8).alias("over_80"),
        (F.sum(F.when(c > 0.8, w).otherwise(0.0)) / total).alias("weight_over_80"),
    )
