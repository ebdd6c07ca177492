"""Content hashes for order-independent splits: FNV-1a, SplitMix64 and key mixing, in numpy over distinct keys."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the hashes.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
GAMMA, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
START = 0x243F6A8885A308D3
_M = (1 << 64) - 1


def fnv1a64(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & _M
    return h


def splitmix64(x: np.ndarray) -> np.ndarray:
    z = x + np.uint64(GAMMA)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def stable_seed(*parts: object) -> int:
    """A CRC-32 chained over the text of the parts."""
    crc = 0
    for p in parts:
        crc = zlib.crc32(str(p).encode(), crc)
    return crc


def threshold(fraction: float) -> int:
    """The hash value below which a share of all hashes lies; the share is between 0 and 1."""
    exact = Fraction(str(round(fraction, 10)))
    if not 0 < exact < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    return int(exact * (1 << 64))


def mix(salt: int, keys: Iterable[pd.Series]) -> np.ndarray:
    """One hash for each row: salt, then each key; strings by FNV-1a, null strings as empty, null numbers as 0.

    Strings are hashed once a batch and distinct value, which for bases and chromosomes are a handful.
    """
    h = None
    with np.errstate(over="ignore"):
        for key in keys:
            if h is None:
                h = splitmix64(np.full(len(key), START ^ salt, dtype=np.uint64))
            if key.dtype == object or str(key.dtype).startswith("str"):
                codes, kinds = pd.factorize(key.fillna(""))
                value = np.array([fnv1a64(str(k).encode()) for k in kinds], dtype=np.uint64)[codes] if len(kinds) else np.zeros(0, np.uint64)
            else:
                value = key.fillna(0).to_numpy(dtype=np.int64).view(np.uint64)
            h = splitmix64(h ^ value)
    return h


def content_split(df: DataFrame, keys: list[str], fraction: float, salt: int, name: str = "is_val") -> DataFrame:
    """df with a column that is true for about a fraction of its distinct keys, whatever the order of rows."""
    limit = np.uint64(threshold(fraction))
    kind = df.schema

    @F.pandas_udf("boolean")
    def chosen(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(mix(salt, part if isinstance(part, tuple) else (part,)) < limit)

    # nulls get their value here: a null would turn a batch of large integers into floats that lose digits
    text = lambda k: kind[k].dataType.typeName() == "string"
    return df.withColumn(
        name,
        chosen(*[F.coalesce(F.col(k), F.lit("")) if text(k) else F.coalesce(F.col(k).cast("long"), F.lit(0).cast("long")) for k in keys]),
    )


def sample_order(seed: int, *keys: str) -> Column:
    """A pseudo-random order that rows have by their keys alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
