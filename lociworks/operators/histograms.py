"""Histograms and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import quantiles


def bin_of(x: Column, lo: float, hi: float, bins: int) -> Column:
    """The bin of a value; what lies outside goes to the first or last one."""
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((x - lo) / ((hi - lo) / bins)))).cast("int")


def histogram(df: DataFrame, by: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(by, bin, n) of finite values."""
    return df.where(finite(F.col(value))).groupBy(*by, bin_of(F.col(value), lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, extent: tuple[float, float, float, float], bins: int) -> DataFrame:
    """(x_bin, y_bin, n, clipped): counts over an extent, and how many of them lay outside."""
    x0, x1, y0, y1 = extent
    fine = df.where(finite(F.col(x)) & finite(F.col(y)))
    outside = ~(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return fine.groupBy(
        bin_of(F.col(x), x0, x1, bins).alias("x_bin"),
        bin_of(F.col(y), y0, y1, bins).alias("y_bin"),
    ).agg(F.count("*").alias("n"), F.count_if(outside).alias("clipped"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def robust_extent(df: DataFrame, column: str, percent: float) -> DataFrame:
    """One row (lo, hi): exact percentiles of finite values at both ends."""
    p = percent / 100
    return quantiles(df.where(finite(F.col(column))), [], column, {"lo": p, "hi": 1 - p}).select("lo", "hi")


def funnel(df: DataFrame, steps: dict[str, Column], value: str) -> DataFrame:
    """One row: how many rows pass the first, the first two, ... of some conditions, and the range of value among the last."""
    passed, out = F.lit(True), []
    for name, condition in steps.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        out.append(F.count_if(passed).alias(name))
    return df.agg(*out, F.min(F.when(passed, F.col(value))).alias("least"), F.max(F.when(passed, F.col(value))).alias("most"))
