"""Streams that survive a restart: the spectrum matrix kept up to date, and early stopping as state of each run.

Results go batch by batch into folders named by the batch's number. A batch that is repeated after a failure overwrites
its own folder, so nothing counts twice; state and progress are in the checkpoint, from which a stopped query goes on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.spectrum import canonical_label
from ..operators.spectra import spectrum_counts


def into_batches(changed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query in update mode that writes what each batch changed and ends when all there is has been read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """For each key what the last batch that changed it says."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def stream_spectrum(observations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Counts by cluster and channel of a streaming feature map; state is one row per cell of the matrix. latest() reads them."""
    c = F.col
    counts = spectrum_counts(observations.withColumn("channel", canonical_label(c("REF"), c("ALT"), c("X_PREV1"), c("X_NEXT1"))))
    return into_batches(counts, path, checkpoint)


_STOP_STATE = "best double, active long, stagnant int, stopped_at long, last long"


def stream_early_stop(epochs: DataFrame, key: str, min_delta: float, patience: int, path: str, checkpoint: str) -> StreamingQuery:
    """early_stop() of a stream of (key, epoch, loss, active): a few numbers of state for each key, whatever the number of epochs.

    A batch's epochs are taken in order; those not after the last one seen are left out, so a key's epochs must come
    in the order of batches. Null epochs and losses are left out. latest() reads (key, best, stagnant, stopped_at).
    """
    kind = epochs.schema[key].dataType.simpleString()

    def fold(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, active, stagnant, stopped, last = state.get if state.exists else (None, None, 0, None, None)
        rows = pd.concat(list(parts)).dropna(subset=["epoch", "loss"]).sort_values("epoch")
        for epoch, loss, units in zip(rows["epoch"], rows["loss"], rows["active"], strict=True):
            if last is not None and epoch <= last:
                continue
            last = int(epoch)
            if stopped is not None:
                continue
            improves = best is None or (best - loss) / max(abs(best), 1e-8) > min_delta
            stagnant = 0 if improves or units != active else stagnant + 1
            best, active = float(loss) if best is None or loss < best else best, int(units)
            if 0 < patience <= stagnant:
                stopped = last
        state.update((best, active, stagnant, stopped, last))
        yield pd.DataFrame({key: [own[0]], "best": [best], "stagnant": [stagnant], "stopped_at": pd.array([stopped], dtype="Int64")})

    rows = epochs.select(F.col(key), F.col("epoch").cast("long"), F.col("loss").cast("double"), F.col("active").cast("long"))
    changed = rows.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, best double, stagnant int, stopped_at long", _STOP_STATE, "update", GroupStateTimeout.NoTimeout)
    return into_batches(changed, path, checkpoint)


def early_stop(epochs: Column, min_delta: float, patience: int) -> Column:
    """The state after each of an ordered array<struct<epoch, loss, active>>: best, stagnant, stopped_at.

    An epoch improves if its gain is over min_delta of the best loss; one that doesn't is stagnant if as many units
    are active as before. Stopped after patience stagnant epochs.
    """
    start = F.struct(
        F.lit(None).cast("double").alias("best"),
        F.lit(None).cast("long").alias("active"),
        F.lit(0).alias("stagnant"),
        F.lit(None).cast("long").alias("stopped_at"),
    )

    def step(s: Column, e: Column) -> Column:
        first = s["best"].isNull()
        gain = (s["best"] - e["loss"]) / F.greatest(F.abs(s["best"]), F.lit(1e-8))
        stagnant = F.when(first | (gain > min_delta) | (e["active"] != s["active"]), 0).otherwise(s["stagnant"] + 1)
        best = F.when(first | (e["loss"] < s["best"]), e["loss"]).otherwise(s["best"])
        stopped = F.when(s["stopped_at"].isNull() & (F.lit(patience) > 0) & (stagnant >= patience), e["epoch"]).otherwise(s["stopped_at"])
        after = F.struct(best.alias("best"), e["active"].cast("long").alias("active"), stagnant.alias("stagnant"), stopped.alias("stopped_at"))
        return F.when(s["stopped_at"].isNotNull(), s).otherwise(after)

    return F.aggregate(epochs, start, step)
