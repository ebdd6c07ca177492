"""Exact-size, nested, stratified, weighted and interleaved samples, all decided by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sample_order
from ..sources.checkpoint import small_side
from .ranks import placed

#: Hex digits of the hash by which rows are counted before any is ranked.
PREFIX = 4


def _prefixed(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    return df.withColumn("_order", sample_order(seed, *keys)).withColumn("_prefix", F.substring("_order", 1, PREFIX))


def hash_places(df: DataFrame, keys: list[str], most: int, seed: int, name: str) -> DataFrame:
    """The rows whose keys hash lowest, most of them at least, with their place from 1 in that order.

    Prefixes of the hash are counted first, at most 16 ** PREFIX of them. Only rows up to the prefix that completes the
    sample are ranked, each prefix by itself.
    """
    own = _prefixed(df, keys, seed)
    sizes = own.groupBy("_prefix").agg(F.count("*").alias("_n"))
    before = sizes.select(
        "_prefix",
        F.coalesce(F.sum("_n").over(Window.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"),
    )
    within = own.join(F.broadcast(before.where(F.col("_ahead") < most)), "_prefix")
    place = F.row_number().over(Window.partitionBy("_prefix").orderBy("_order", *keys)) + F.col("_ahead")
    return within.withColumn(name, place).drop("_order", "_prefix", "_ahead")


def exact_sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """The n rows whose keys hash lowest."""
    return hash_places(df, keys, n, seed, "_at").where(F.col("_at") <= n).drop("_at")


def nested_samples(df: DataFrame, keys: list[str], sizes: list[int], seed: int, replicates: int = 1) -> DataFrame:
    """(replicate, size, keys): samples of each size, the smaller within the larger, in an order of its own for each replicate."""
    parts = None
    for k in range(replicates):
        at = hash_places(df.select(*keys), keys, max(sizes), seed + k, "_at").withColumn("replicate", F.lit(k))
        parts = at if parts is None else parts.unionAll(at)
    return parts.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where("_at <= size").drop("_at")


def disjoint_probe(df: DataFrame, keys: list[str], taken: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows that are in none of the samples taken."""
    return exact_sample(df.join(taken.select(*keys).distinct(), keys, "left_anti"), keys, n, seed)


def permutation_split(df: DataFrame, keys: list[str], fraction: float, seed: int) -> DataFrame:
    """df with is_val: exactly int(n * fraction) rows, at least one and at most all but one."""
    n = df.count()
    if n < 2:
        raise ValueError("a split needs two rows or more")
    held = min(max(int(n * fraction), 1), n - 1)
    return hash_places(df, keys, n, seed, "_at").withColumn("is_val", F.col("_at") <= held).drop("_at")


def clamped(requested: int | None, eligible: int) -> int:
    """How many rows a sample gets: as asked, at most those there are; no request means all. None eligible is an error."""
    if eligible <= 0:
        raise ValueError("no row is eligible")
    return eligible if requested is None else min(requested, eligible)


def stratified_sample(df: DataFrame, by: str, keys: list[str], quota: int, seed: int) -> DataFrame:
    """At most quota rows of each stratum. The group limit of the ranking cuts each task's rows before the shuffle."""
    order = Window.partitionBy(by).orderBy(sample_order(seed, *keys), *keys)
    return df.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= quota).drop("_at")


def budget_sample(df: DataFrame, by: str, keys: list[str], budget: int, seed: int) -> DataFrame:
    """A total budget of rows, water-filled over strata: small ones are taken whole, the rest share alike.

    The share follows from how many strata have which size. Where there are more strata than the budget has rows, the first ones
    get one each.
    """
    own = df.where(F.col(by).isNotNull())
    sizes = own.groupBy(by).agg(F.count("*").alias("_n"))
    share = level([(r["_n"], r["strata"]) for r in sizes.groupBy("_n").agg(F.count("*").alias("strata")).collect()], budget)  # a row a size
    if share == 0:
        own, share = own.join(sizes.orderBy(by).limit(budget).select(by), by, "left_semi"), 1
    return stratified_sample(own, by, keys, share, seed).select(df.columns)


def level(sizes: list[tuple[int, int]], budget: int) -> int:
    """The greatest share such that strata of (size, how many) take no more than a budget together, each at most its size."""
    taken, strata, below = 0, sum(n for _, n in sizes), 0
    for size, n in sorted(sizes):
        if taken + (size - below) * strata > budget:
            return below + (budget - taken) // strata
        taken, below, strata = taken + (size - below) * strata, size, strata - n
    return below


def weighted_draw(df: DataFrame, order: str, weight: str, draws: DataFrame, at: str) -> DataFrame:
    """draws with the row of df whose stretch of the cumulative weight holds the share at (0 <= at < 1).

    Stretches and draws are placed in one order of the cumulative weight, in ranges, and each draw takes the last stretch
    that begins at or before it.
    """
    total = df.agg(F.sum(F.col(weight).cast("double")).alias("t")).first()["t"]
    if not total or total <= 0:
        raise ValueError("weights must not be all zero")
    parts = placed(df.where(F.col(weight) > 0), [order], F.lit(1), "_rank")
    bands = parts.withColumn("_band", F.floor(F.col("_rank") / BAND))
    sums = bands.groupBy("_band").agg(F.sum(weight).alias("_s"))  # one row for each BAND rows
    ahead = sums.select("_band", F.coalesce(F.sum("_s").over(Window.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_ahead"))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("_band").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    begins = bands.join(ahead, "_band").withColumn("_begin", (own + F.col("_ahead")) / total)
    # a draw looks among the rows of the last band that begins at or before it
    edges = ahead.select("_band", (F.col("_ahead") / total).alias("_from"), F.lead(F.col("_ahead") / total, 1, 2.0).over(Window.orderBy("_band")).alias("_to"))
    met = draws.join(F.broadcast(edges), (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to"))).drop("_from", "_to")
    found = met.join(begins.select("_band", F.col(order).alias("_row"), "_begin"), "_band").where(F.col("_begin") <= F.col(at))
    return found.groupBy(*draws.columns).agg(F.max_by("_row", "_begin").alias(order))


#: Rows whose weights are added up together before draws are looked up among them.
BAND = 4096


def hamilton(weights: list[float], seats: int) -> list[int]:
    """Seats by largest remainder; ties go to the lower index."""
    total = sum(weights)
    if not weights or total <= 0 or any(w < 0 for w in weights):
        raise ValueError("weights must be there, not negative and not all zero")
    quotas = [w * seats / total for w in weights]
    out = [int(q) for q in quotas]
    for i in sorted(range(len(out)), key=lambda i: (-(quotas[i] - out[i]), i))[: seats - sum(out)]:
        out[i] += 1
    return out


def apportion(sizes: DataFrame, by: str, size: str, seats: int) -> DataFrame:
    """(by, size, draw): seats of a batch by largest remainder, over one small row for each group."""
    everything = Window.partitionBy(F.lit(0))
    quota = F.col(size).cast("double") * seats / F.sum(size).over(everything)
    q = sizes.select(by, size, quota.alias("quota")).withColumn("whole", F.floor("quota"))
    left = F.lit(seats) - F.sum("whole").over(everything)
    ranked = q.withColumn("left", left).withColumn("place", F.row_number().over(everything.orderBy(F.round(F.col("quota") - F.col("whole"), 9).desc(), by)))
    return ranked.select(by, size, (F.col("whole") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("draw"))


def starving(draws: DataFrame, seats: int) -> DataFrame:
    """One row: groups, those that a batch draws nothing from, the least batch that could draw from all, and whether the batch is refused."""
    n = F.count("*")
    starved = F.count_if(F.col("draw") <= 0)
    return draws.agg(n.alias("groups"), starved.alias("starved"), (F.lit(seats) < n).alias("too_small"), ((F.lit(seats) < n) | (starved > 0)).alias("refused"))


def _fed(draw: Column, by: str) -> Column:
    """The draw of a group, or an error if it is nothing: such a group's rows would never be in a batch."""
    return F.when(draw > 0, draw).otherwise(F.raise_error(F.concat(
        F.lit("a batch draws no row of "),
        F.coalesce(F.col(by).cast("string"), F.lit("null")),
        F.lit("; take a larger batch"),
    )))


def interleaved(df: DataFrame, by: str, keys: list[str], batch: int, seed: int, bins: int = 4096) -> DataFrame:
    """df with a batch number so that each batch draws from each group by its share and every row is in one batch.

    A group that a batch would draw nothing from is an error. A row's place in its group is counted in two steps, within
    bins of the hash and then over bins, so a group that holds most rows isn't ranked in one task. bins: up to 65,536.
    """
    binned = df.withColumn("_order", sample_order(seed, *keys)).withColumn(
        "_bin",
        F.floor(F.conv(F.substring("_order", 1, 4), 16, 10).cast("int") * bins / 65536).cast("int"),
    )
    sizes = binned.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    own = Window.partitionBy(by)
    before = sizes.select(
        by,
        "_bin",
        F.coalesce(F.sum("_n").over(own.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(own).alias("_size"),
    )
    draws = apportion(before.groupBy(by).agg(F.first("_size").alias("_size")), by, "_size", batch)
    known = before.join(
        small_side(draws.select(F.col(by).alias("_group"), "draw")),
        F.col(by).eqNullSafe(F.col("_group")),
    ).select(F.col(by).alias("_by"), F.col("_bin").alias("_of"), "_before", "draw")
    place = F.row_number().over(Window.partitionBy(by, "_bin").orderBy("_order", *keys))
    ranked = binned.withColumn("_place", place).join(known, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bin") == F.col("_of")))
    number = F.floor((F.col("_place") + F.col("_before") - 1) / _fed(F.col("draw"), by))
    return ranked.withColumn("batch_id", number).select(*df.columns, "batch_id")


def epoch_shard(groups: DataFrame, by: str, group: str, epoch: int, shards: int, seed: int) -> DataFrame:
    """The groups of each source that an epoch reads: a new order each cycle of epochs, each group once a cycle."""
    cycle = epoch // shards
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.md5(F.concat_ws("|", F.lit(f"{seed}|{cycle}"), by, F.col(group).cast("string"))), group)) - 1
    return groups.withColumn("_place", place).where(F.col("_place") % shards == epoch % shards).drop("_place")
