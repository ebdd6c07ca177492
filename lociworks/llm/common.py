"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* input tables are DataFrames; only the columns an operator names are read, so
  extra columns, whatever they are called, never clash with its own;
* a null text counts as the empty text unless a docstring says otherwise;
* a repeated row gives a repeated result row; a result depends on the text of
  its own row, never on row order;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python task works on at a time.
SLICE_BYTES = 8 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and nothing else.
ASCII_LOWER = str.maketrans(_UPPER, _LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the built-in fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the given fold."""
    return F.crc32(doc_id.cast("string")) % folds == fold


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that tell rows apart as far as results can differ: id and text."""
    return [doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key")]


def _shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset a local session, as in tests, makes one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = sc.getConf().get("spark.checkpoint.dir")
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="lociworks-ckpt-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage there."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as a Parquet table of its own, of which later reads take only the columns that they need."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by a shuffle whatever Spark takes its size to be, so that it never passes through the driver."""
    return df.hint("merge")


def text_slices(
    batches: Iterable[pa.RecordBatch],
    limit: int = SLICE_BYTES,
    text: Callable[[pa.RecordBatch], pa.Array] = lambda batch: batch.column("text"),
) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about ``limit`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = text(batch)
        if column.nbytes <= limit:
            yield batch
            continue
        start, size = 0, 0
        lengths = pc.binary_length(column).fill_null(0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def vocabulary_bytes(path: str) -> bytes:
    """A public tokenizer's file, read on the driver and sent to tasks; its size is fixed."""
    with open(path, "rb") as f:
        return f.read()
