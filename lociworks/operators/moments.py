"""Column statistics as mergeable moments."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.checkpoint import small_side
from ..sources.shared import Files


def nonnull_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of non-null counts, in one pass."""
    return df.agg(*[F.count(c).alias(c) for c in columns])


def fused_moments(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, feature, n_rows, n, mean, m2) for each group and column, in one pass over all files."""
    sums = [x for c in columns for x in (
        F.count(c).alias(f"n_{c}"),
        F.avg(F.col(c).cast("double")).alias(f"mean_{c}"),
        F.var_samp(F.col(c).cast("double")).alias(f"var_{c}"),
    )]
    wide = df.groupBy(by).agg(F.count("*").alias("n_rows"), *sums)
    rows = F.array(*[F.struct(
        F.lit(c).alias("feature"),
        F.col(f"n_{c}").alias("n"),
        F.col(f"mean_{c}").alias("mean"),
        F.col(f"var_{c}").alias("var"),
    ) for c in columns])
    long = wide.select(by, "n_rows", F.explode(rows).alias("x")).select(by, "n_rows", "x.*")
    fine = (F.col("n") > 0) & ~F.isnan("mean") & (F.abs("mean") < float("inf"))
    var = F.when(F.col("var").isNull() | F.isnan("var") | (F.col("var") < 0) | (F.col("var") == float("inf")), 0.0).otherwise(F.col("var"))
    return long.select(
        by,
        "n_rows",
        "feature",
        F.when(fine, F.col("n")).otherwise(F.lit(0).cast("long")).alias("n"),
        F.when(fine, F.col("mean")).otherwise(0.0).alias("mean"),
        F.when(fine, var * F.greatest(F.col("n") - 1, F.lit(0))).otherwise(0.0).alias("m2"),
    )


def merge_pair(a: Column, b: Column) -> Column:
    """The moments (n, mean, m2) of two sets of rows together; n = 0 is neutral."""
    n = a["n"] + b["n"]
    delta = b["mean"] - a["mean"]
    whole = F.struct(n.alias("n"), (a["mean"] + delta * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + delta * delta * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(whole)


#: Parts that are merged in one group.
FANOUT = 16


def merge_moments(parts: DataFrame, order: str) -> DataFrame:
    """(feature, n, mean, m2) over all groups, merged as a tree in a fixed order.

    Each level merges FANOUT neighbours, so no task sees the parts of all files, and errors grow with the levels only.
    """
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(order)) - 1
    level = parts.select(
        "feature",
        rank.alias("at"),
        F.struct(*[F.col(c).cast(k).alias(c) for c, k in (("n", "long"), ("mean", "double"), ("m2", "double"))]).alias("m"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    most = parts.groupBy("feature").count().agg(F.max("count")).first()[0] or 1
    while True:
        gathered = level.groupBy("feature", F.floor(F.col("at") / FANOUT).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("all"))
        level = gathered.select("feature", "at", F.aggregate("all", zero, lambda acc, x: merge_pair(acc, x["m"])).alias("m"))
        if (most := -(-most // FANOUT)) <= 1:
            return level.select("feature", "m.n", "m.mean", "m.m2")


def standard_scale(merged: DataFrame) -> DataFrame:
    """(feature, n, mean, std) of features with values: sample deviation, 1 where it is below 1e-6 or not finite."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return merged.where("n > 0").select("feature", "n", "mean", F.when(F.isnan(std) | (std < 1e-6), 1.0).otherwise(std).alias("std"))


class MomentCache:
    """Moments of files kept by path, sizes, times, filter and columns, in a folder of any file system; entries are renamed into place."""

    def __init__(self, spark: SparkSession, folder: str):
        self._files, self._folder = Files(spark), folder

    def key(self, path: str, where: str, columns: list[str]) -> str:
        return hashlib.sha256(json.dumps(["2", self._files.stats(path), where, columns]).encode()).hexdigest()[:32]

    def get(self, key: str) -> list[dict] | None:
        """The entry, or nothing where there is none or it is no JSON."""
        path = f"{self._folder}/{key}.json"
        if not self._files.exists(path):
            return None
        try:
            return json.loads(self._files.read(path))
        except ValueError:
            return None

    def put(self, key: str, rows: list[dict]) -> None:
        self._files.write(f"{self._folder}/{key}.json", json.dumps(rows).encode())


def file_moments(spark, paths: list[str], where: str, columns: list[str], cache: MomentCache) -> DataFrame:
    """Moments of each file, and whether the cache had them; all files that it lacks are read in one job."""
    keys = {p: cache.key(p, where, columns) for p in paths}
    known = {p: rows for p in paths if (rows := cache.get(keys[p])) is not None}
    if new := [p for p in paths if p not in known]:
        # one scan of all files; each tells which of the given paths it is under
        plain = lambda f: re.sub("^([a-z0-9]+):/+", r"\1:/", f)  # noqa: E731  the scan and the listing write roots differently
        under = {plain(f): p for p in new for f in spark.read.parquet(p).inputFiles()}
        owners = spark.createDataFrame(list(under.items()), "file string, path string")
        rows = spark.read.option("mergeSchema", True).parquet(*new).select("*", F.regexp_replace("_metadata.file_path", "^([a-z0-9]+):/+", "$1:/").alias("file")).where(where)
        parts = rows.join(small_side(owners), "file").select("path", *columns)
        got: dict[str, list[dict]] = {p: [] for p in new}
        for r in fused_moments(parts, "path", columns).collect():  # files times columns
            got[r["path"]].append(r.asDict())
        for p, rows in got.items():
            if not rows:
                raise ValueError(f"{p} has no rows after the filter")
            cache.put(keys[p], rows)
        known |= got
    rows = [{**r, "cached": p not in new} for p in paths for r in known[p]]
    return spark.createDataFrame(rows, "path string, n_rows long, feature string, n long, mean double, m2 double, cached boolean")
