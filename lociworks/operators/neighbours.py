"""Exact nearest neighbours of a query set among all rows, and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from . import balls
from .ranks import quantiles


def knn_join(queries: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", itself: bool = False, index: balls.Index | None = None) -> DataFrame:
    """(q, id, distance, place): the k nearest rows of each query by Euclidean distance, place from 1.

    A query's own row is left out by its id, unless itself is true. Through the index of balls: exact, and a query
    meets only the cells that can hold one of its neighbours. index: that of rows, if there is one.
    """
    return balls.nearest(balls.as_vectors(queries, id_col, vector, "q"), index or balls.build(rows, id_col, vector), k, itself)


def ranks_among_all(pairs: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", index: balls.Index | None = None) -> DataFrame:
    """(q, id, rank): of pairs (q, id) the exact rank of id by distance from q among all other rows, from 1; no list is cut."""
    return balls.ranks(pairs, rows, id_col, vector, index)


def knn_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """(q, overlap): the share of k neighbours that two neighbour tables have in common."""
    a = checkpointed(a)  # it is read twice
    both = a.where(F.col("place") <= k).select("q", "id").join(
        b.where(F.col("place") <= k).select("q", "id"),
        ["q", "id"],
    ).groupBy("q").agg(F.count("*").alias("n"))
    return a.select("q").distinct().join(both, "q", "left").select("q", (F.coalesce("n", F.lit(0)) / k).alias("overlap"))


def connectivity(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(q, same): the share of a query's neighbours that have its label. labels: (id, label)."""
    own = labels.select(F.col("id").alias("q"), F.col("label").alias("own"))
    return neighbours.join(labels, "id").join(own, "q").groupBy("q").agg(F.avg((F.col("label") == F.col("own")).cast("double")).alias("same"))


def interpolate(neighbours: DataFrame, coordinates: DataFrame, columns: list[str], eps: float = 1e-8) -> DataFrame:
    """(q, columns): the mean of the neighbours' coordinates by inverse distance. coordinates: (id, columns)."""
    w = 1 / (F.col("distance") + eps)
    return neighbours.join(coordinates, "id").groupBy("q").agg(*[(F.sum(w * F.col(c)) / F.sum(w)).alias(c) for c in columns])


def core_distance(neighbours: DataFrame, samples: int) -> DataFrame:
    """(q, core): the distance of the samples-th neighbour, the query itself counted."""
    return neighbours.where(F.col("place") == samples).select("q", F.col("distance").alias("core"))


def connectivity_summary(same: DataFrame) -> DataFrame:
    """One row over connectivity(): mean, median, shares of pure queries and of those with less than half."""
    x, same = F.col("same"), checkpointed(same)  # it is read twice
    one = same.agg(F.avg(x).alias("mean"), F.avg((x >= 1.0).cast("double")).alias("pure"), F.avg((x < 0.5).cast("double")).alias("under_half"))
    return one.join(quantiles(same, [], "same", {"median": 0.5}).drop("n"), how="cross")  # one row each


def coranking(high: DataFrame, low: DataFrame, rank_high: DataFrame, rank_low: DataFrame, k: int, n: int) -> DataFrame:
    """One row: trustworthiness and continuity from exact ranks, Q_NX at k, and the mean of R_NX over 1..k by 1/K.

    high, low: neighbour tables of depth k or more among n rows; rank_high: ranks of low's neighbours in high, rank_low the
    other way round.
    """

    def penalty(ranks: DataFrame) -> DataFrame:
        return ranks.agg(F.sum(F.greatest(F.col("rank") - k, F.lit(0))).alias("s"))

    m = high.agg(F.count_distinct("q")).scalar()
    scale = lambda s: 1 - 2 / (m * k * (2 * n - 3 * k - 1)) * s
    cut = lambda df, name: df.where(F.col("place") <= k).select("q", "id", F.col("place").alias(name))
    both = cut(high, "h").join(cut(low, "l"), ["q", "id"]).groupBy(F.greatest("h", "l").alias("from")).agg(F.count("*").alias("pairs"))
    sizes = high.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("size"))
    upto = sizes.join(F.broadcast(both), F.col("from") <= F.col("size"), "left").groupBy("size").agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))  # k rows
    q_nx = upto.select("size", (F.col("pairs") / (m * F.col("size"))).alias("q")).withColumn(
        "r",
        ((n - 1) * F.col("q") - F.col("size")) / (n - 1 - F.col("size")),
    )
    one = q_nx.agg(
        F.max(F.when(F.col("size") == k, F.col("q"))).alias("q_nx"),
        (F.sum(F.col("r") / F.col("size")) / F.sum(1 / F.col("size"))).alias("r_nx_auc"),
    )
    return one.select(
        penalty(rank_high).select(scale(F.col("s"))).scalar().alias("trustworthiness"),
        penalty(rank_low).select(scale(F.col("s"))).scalar().alias("continuity"),
        "q_nx",
        "r_nx_auc",
    )
