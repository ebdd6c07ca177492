"""Scans: path resolution, tolerant projection, physical row ids, unions by name."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resolve_paths(spark: SparkSession, patterns: Iterable[str]) -> list[str]:
    """Files of some patterns on any file system, sorted by base name, each once. A pattern without files is an error."""
    files, found = Files(spark), {}
    for pattern in patterns:
        matches = files.glob(pattern)
        if not matches:
            raise FileNotFoundError(pattern)
        found |= dict.fromkeys(matches)
    return sorted(found, key=lambda path: (path.rpartition("/")[2], path))


def sample_id(file_name: Column) -> Column:
    """The base name of a file up to its first dot."""
    return F.regexp_extract(file_name, r"([^/.]*)[^/]*$", 1)


def existing(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Those of the wanted columns that there are, in the order wanted, each once."""
    have = [c for c in dict.fromkeys(wanted) if c in df.columns]
    if not have:
        raise ValueError("none of the requested columns exists")
    return have


def scan(df: DataFrame, columns: Iterable[str] | None = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Filter, then tolerant projection, then limit. Catalyst pushes filter and columns into the Parquet scan."""
    out = df.where(where) if where else df
    if columns is not None:
        out = out.select(*existing(df, columns))
    return out if limit is None else out.limit(limit)


def with_row_number(df: DataFrame, name: str = "file_row_number") -> DataFrame:
    """Adds the physical position of each row in its file; refuses a column of that name."""
    if name in df.columns:
        raise ValueError(f"the source already has {name}")
    return df.withColumn(name, F.col("_metadata.row_index"))


def cast_or_null(df: DataFrame, column: str, kind: str) -> Column:
    """The column as kind, or a typed null if there is none."""
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def union_by_name(parts: dict[str, DataFrame], name: str = "sample") -> DataFrame:
    """All parts under each other by column name, absent columns null, with the part's key as a column."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def view_name(sample: Column) -> Column:
    """A sample's name as SQL allows it for a view."""
    plain = F.regexp_replace(F.regexp_replace(sample, r"\.featuremap$", ""), "[^0-9A-Za-z_]", "_")
    return F.when(plain.rlike("^[0-9]"), F.concat(F.lit("s_"), plain)).otherwise(plain)


def multi_file(spark: SparkSession, paths: list[str], name: str = "sample") -> DataFrame:
    """Several files in one scan, columns by name, with the sample that each row's file names."""
    return spark.read.option("mergeSchema", True).parquet(*paths).withColumn(name, sample_id(F.col("_metadata.file_path")))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True)


def create_views(parts: dict[str, DataFrame]) -> dict[str, str]:
    """A temporary view of each sample, under a name that SQL allows; the names by sample."""
    out = {}
    for sample, df in parts.items():
        plain = re.sub("[^0-9A-Za-z_]", "_", sample.removesuffix(".featuremap"))
        out[sample] = f"s_{plain}" if plain[:1].isdigit() else plain
        df.createOrReplaceTempView(out[sample])
    return out
