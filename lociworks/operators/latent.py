"""Latent tables: moments over rows, and likeness of two representations, from sums of products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_of(vector: str, width: int) -> list[Column]:
    return [F.col(vector)[i].cast("double") for i in range(width)]


def activation(df: DataFrame, vector: str, width: int, least: float = 1e-2) -> DataFrame:
    """(dim, mean, variance, active) of each dimension; variance over n, active if it is at least ``least``."""
    x = columns_of(vector, width)
    one = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)])
    rows = F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance")) for i in range(width)])
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("active", F.col("variance") >= least)


def cross_moments(df: DataFrame, a: list[Column], b: list[Column]) -> dict[str, np.ndarray | float]:
    """n and cross products, centred and as they are, of two sets of columns, over rows without nulls; d * d numbers reach the driver.

    A first pass takes means, a second one adds up products of what is left, so large means take no digits away.
    """
    both, k = [*a, *b], len(a)
    own = df.select(F.array(*[c.cast("double") for c in both]).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    row = own.agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("v")[i]) for i in range(len(both))]).alias("mean")).first()
    n, mean = row["n"], np.array([x or 0.0 for x in row["mean"]])
    sent = df.sparkSession.sparkContext.broadcast(mean)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sent.value), len(sent.value)))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1) - sent.value
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "p"])

    sums = own.mapInArrow(run, "i int, p array<double>").select("i", F.posexplode("p").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    centred = np.zeros((len(both), len(both)))
    for i, j, x in sums.collect():
        centred[i, j] = x
    raw = centred + n * np.outer(mean, mean)
    return {"n": n, "aa": centred[:k, :k], "bb": centred[k:, k:], "ab": centred[:k, k:], "raw_aa": raw[:k, :k], "raw_bb": raw[k:, k:], "raw_ab": raw[:k, k:]}


def linear_cka(m: dict) -> float:
    """Centred, in feature space."""
    return float((m["ab"] ** 2).sum() / (np.linalg.norm(m["aa"]) * np.linalg.norm(m["bb"])))


def gram_likeness(m: dict) -> float:
    """1 - |Gx - Gy| / (|Gx| |Gy|) with uncentred Gram matrices over rows: not the usual CKA, kept under its own name."""
    xx, yy = (m["raw_aa"] ** 2).sum(), (m["raw_bb"] ** 2).sum()
    apart = max(0.0, xx + yy - 2 * (m["raw_ab"] ** 2).sum())
    return float(1 - np.sqrt(apart) / np.sqrt(xx * yy))


def procrustes(m: dict, squared: bool = False) -> float:
    """Disparity of centred tables of unit norm: 2 - 2 * sum of singular values, or 1 - its square."""
    norm = np.sqrt(np.trace(m["aa"]) * np.trace(m["bb"]))
    if not norm:
        return float("nan")
    total = np.linalg.svd(m["ab"], compute_uv=False).sum() / norm
    return float(max(0.0, 1 - total**2 if squared else 2 - 2 * total))


def participation_ratio(m: dict) -> float:
    """How many dimensions share the variance: the squared trace over the trace of the square."""
    return float(np.trace(m["aa"]) ** 2 / (m["aa"] ** 2).sum())
