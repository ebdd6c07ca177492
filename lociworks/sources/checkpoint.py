"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local session, as in tests, makes one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="lociworks-"))
    return sc.getCheckpointDir()


#: Rows of a side up to which it is broadcast; they are few numbers each.
SMALL_ROWS = 100_000


def small_side(df: DataFrame) -> DataFrame:
    """df written down, to be broadcast if it has few rows, and else joined by a shuffle."""
    held = checkpointed(df)
    return F.broadcast(held) if held.count() <= SMALL_ROWS else held


def own_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
