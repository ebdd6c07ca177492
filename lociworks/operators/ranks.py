"""Exact ranks and quantiles without a task that sees all rows.

Equal values are counted first. What is left, one row a value, is dealt by range
and written down, and each range's rows begin where the ranges before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed, small_side


def placed(df: DataFrame, order: list[str], weight: Column | None = None, name: str = "_before") -> DataFrame:
    """df, written down, with how many rows (or how much weight) stand before each in an order."""
    w = F.lit(1) if weight is None else weight
    parts = checkpointed(df.withColumn("_w", w.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.sum("_w").alias("_n"))  # one row a partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.coalesce(F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_ahead")).drop("_part", "_own", "_ahead", "_w")


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, before): each distinct value of a group, how often it occurs, and how many rows of the group are less."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    all_placed = placed(counts, [*by, value], F.col("n"))
    if not by:
        return all_placed.select(value, "n", F.col("_before").alias("before"))
    all_placed = checkpointed(all_placed)
    begins = all_placed.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min("_before").alias("_begin"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return all_placed.join(begins, on).select(*by, value, "n", (F.col("_before") - F.col("_begin")).alias("before"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, name of each share): exact quantiles, interpolated between neighbours."""
    ranked = checkpointed(value_ranks(df, by, value))
    total = ranked.groupBy(*by).agg(F.sum("n").alias("_total"))
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    met = ranked.join(small_side(total.select(*[F.col(c).alias(f"_t_{c}") for c in by], "_total")), on)
    out = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_total") - 1)
        holds = lambda place: (F.col("before") <= place) & (place < F.col("before") + F.col("n"))
        lo, hi = (F.max(F.when(holds(place), F.col(value).cast("double"))) for place in (F.floor(at), F.ceil(at)))
        out.append((lo + (hi - lo) * F.max(at - F.floor(at))).alias(name))
    return met.groupBy(*by).agg(F.max("_total").alias("n"), *out)
