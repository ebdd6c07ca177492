"""Spectrum matrices over clusters, and their concentration and likeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spectrum import canonical_label, channels
from ..sources.checkpoint import checkpointed

#: Reference, alternative and the bases on both sides.
BASES = ["REF", "ALT", "X_PREV1", "X_NEXT1"]


def spectrum_counts(df: DataFrame, label: str = "cluster_label", channel: str = "channel") -> DataFrame:
    """(label, channel, n) without noise, unlabelled rows and unknown channels."""
    return df.where((F.col(label) >= 0) & F.col(channel).isNotNull()).groupBy(label, channel).agg(F.count("*").alias("n"))


def counts_by_bases(df: DataFrame, label: str = "cluster_label", **more: Column) -> DataFrame:
    """spectrum_counts() of rows without a channel, and sums of more counts: rows are counted by their bases, and only those groups get labels."""
    counted = df.where(F.col(label) >= 0).groupBy(label, *BASES).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()])
    named = counted.withColumn("channel", canonical_label(*map(F.col, BASES))).where("channel IS NOT NULL")
    return named.groupBy(label, "channel").agg(*[F.sum(k).alias(k) for k in ("n", *more)])


def matrix_long(counts: DataFrame, label: str = "cluster_label") -> DataFrame:
    """(label, channel, n) for every cluster and each of the 96 channels, zeros written out."""
    counts = checkpointed(counts)  # at most 96 rows a cluster, which are read twice
    every = counts.select(label).distinct().withColumn("channel", F.explode(F.array(*map(F.lit, channels()))))
    return every.join(counts, [label, "channel"], "left").select(label, "channel", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def matrix_wide(long: DataFrame, labels: list[int] | None = None, label: str = "cluster_label") -> DataFrame:
    """One row per channel, one column cluster_<id> per cluster, of the given clusters or of all there are."""
    if labels is None:
        labels = [r[0] for r in long.select(label).distinct().orderBy(label).collect()]  # they become columns
    wide = long.groupBy("channel").pivot(label, labels).agg(F.first("n")).na.fill(0)
    return wide.select("channel", *[F.col(f"`{k}`").alias(f"cluster_{k}") for k in labels])


def side_counters(df: DataFrame, label: str = "cluster_label", channel: str = "channel") -> DataFrame:
    return df.agg(
        F.count_if(F.col(label) < 0).alias("noise_rows"),
        F.count_if(F.col(channel).isNull()).alias("unclassified_rows"),
        F.count("*").alias("n_rows"),
    )


def top_channel(counts: DataFrame, label: str = "cluster_label") -> DataFrame:
    """(label, total, top_channel, share): ties go to the first channel."""
    total = counts.groupBy(label).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "channel"))).alias("all"))
    return total.select(label, "total", F.col("all")[0]["channel"].alias("top_channel"), (-F.col("all")[0]["m"] / F.col("total")).alias("share"))


def channels_for(counts: DataFrame, share: float = 0.9, label: str = "cluster_label") -> DataFrame:
    """(label, n_channels): how many of the largest channels hold the share."""
    order = Window.partitionBy(label).orderBy(F.desc("n"), "channel").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"))
    short = before.join(totals, label).withColumn("short", F.col("before") / F.col("total") < share - 1e-9)
    return short.groupBy(label).agg(F.count_if("short").alias("n_channels"))


def pairwise(counts: DataFrame, label: str = "cluster_label") -> DataFrame:
    """(a, b, cosine, l1, l2) of each pair of clusters' shares. Clusters meet on channels; pairs that share none have cosine 0 and l1 2."""
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
    norms = totals.select(F.col(label).alias("k"), (F.sqrt("squares") / F.col("total")).alias("norm"))
    share = counts.join(totals, label).select(F.col(label).alias("k"), "channel", (F.col("n") / F.col("total")).alias("p"))
    sides = lambda df: [df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns]) for s in "ab"]
    (a, b), (x, y) = sides(share), sides(norms)
    met = a.join(b, (F.col("channel_a") == F.col("channel_b")) & (F.col("k_a") < F.col("k_b"))).groupBy("k_a", "k_b")
    sums = met.agg(F.sum(F.col("p_a") * F.col("p_b")).alias("dot"), F.sum(F.least("p_a", "p_b")).alias("common"))
    # every pair is a row of the result, whether or not it has met
    pairs = x.join(y, F.col("k_a") < F.col("k_b")).join(sums, ["k_a", "k_b"], "left").na.fill(0.0, ["dot", "common"])
    x, y, dot = F.col("norm_a"), F.col("norm_b"), F.col("dot")
    # shares add up to 1, so absent channels are told by what is common
    return pairs.select(
        F.col("k_a").alias("a"),
        F.col("k_b").alias("b"),
        (dot / (x * y)).alias("cosine"),
        (2 - 2 * F.col("common")).alias("l1"),
        F.sqrt(F.greatest(F.lit(0.0), F.pow(x, 2) + F.pow(y, 2) - 2 * dot)).alias("l2"),
    )


def top_contexts(counts: DataFrame, n: int, label: str = "cluster_label") -> DataFrame:
    order = Window.partitionBy(label).orderBy(F.desc("n"), "channel")
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def dominant_category(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with the name of the largest column, its value and share; the first of equal ones, share 0 if all are 0."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    most = F.greatest(*[F.col(c) for c in columns])
    name = F.lit(None).cast("string")
    for c in reversed(columns):
        name = F.when(F.col(c) == most, F.lit(c)).otherwise(name)
    return df.withColumns({"dominant": name, "dominant_count": most, "dominant_share": F.when(total == 0, 0.0).otherwise(most / total)})
