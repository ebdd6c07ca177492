"""Feature encoding: category codes and masked standardisation."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str
    codes: dict[str, int] = field(default_factory=dict)

    @property
    def null_token(self) -> str:
        return "" if "" in self.codes or not self.codes else next(iter(self.codes))

    @property
    def width(self) -> int:
        """Of an embedding of this feature."""
        return max(2, min(16, 2 * math.ceil(math.sqrt(len(self.codes)))))


def load_spec(text: str) -> list[FeatureSpec]:
    return [FeatureSpec(x["name"], x["kind"], x.get("codes", {})) for x in json.loads(text)]


def spec_fingerprint(spec: list[FeatureSpec]) -> str:
    return hashlib.sha256(json.dumps([[s.name, s.kind, s.codes] for s in spec]).encode()).hexdigest()[:16]


def category_code(column: Column, spec: FeatureSpec) -> Column:
    """The code of the value as text; nulls and unknown values have the null token's."""
    default = spec.codes.get(spec.null_token, 0)
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(spec.codes.items())])
    return F.coalesce(F.try_element_at(known, column.cast("string")), F.lit(default))


def standardised(column: Column, mean: float, std: float) -> Column:
    """(x - mean) / std in 32 bits; 0 where the value is null or not a number."""
    x, m, s = column.cast("float"), F.lit(mean).cast("float"), F.lit(std).cast("float")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0).cast("float")).otherwise((x - m).cast("float") / s).cast("float")


def mask(column: Column) -> Column:
    x = column.cast("float")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(1.0).cast("float")
