"""Applying given models row by row: encoders, projection and signature activities, in Arrow batches over broadcast weights."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.encode import FeatureSpec, category_code, standardised


@dataclass
class Layers:
    """Weights and biases of a network with ReLU between its layers."""

    weights: list[np.ndarray]
    biases: list[np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            x = x @ w + b
            if i + 1 < len(self.weights):
                x = np.maximum(x, 0)
        return x

    @staticmethod
    def fixed(widths: list[int], seed: int) -> Layers:
        rng = np.random.default_rng(seed)
        return Layers([rng.normal(0, (2 / a) ** 0.5, (a, b)) for a, b in zip(widths, widths[1:])], [np.zeros(b) for b in widths[1:]])


def apply_layers(df: DataFrame, layers: Layers, key: str, vector: str, out: str = "latent") -> DataFrame:
    """(key, out array<float>) for the vector of each row. Null vectors give null."""
    sent = df.sparkSession.sparkContext.broadcast(layers)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            at = [i for i, r in enumerate(rows) if r is not None]
            made: list = [None] * len(rows)
            if at:
                for i, y in zip(at, sent.value(np.array([rows[i] for i in at], dtype=np.float64)).astype(np.float32)):
                    made[i] = y
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float32()))], ["key", out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("key"), df[vector].alias("v")).mapInArrow(run, f"key {kind}, {out} array<float>").withColumnRenamed("key", key)


@dataclass
class MixedEncoder:
    """An encoder over categories and masked numbers: a table of vectors for each category, then layers.

    tables: by feature, a row for each code. The vectors of all categories, in their order, stand before the numbers.
    """

    tables: dict[str, np.ndarray]
    layers: Layers

    def __call__(self, codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        parts = [t[codes[:, i]] for i, t in enumerate(self.tables.values())]
        return self.layers(np.concatenate([*parts, numbers], axis=1))


def weights_table(spark: SparkSession, encoder: MixedEncoder) -> DataFrame:
    """(part, name, i, j, w): an encoder as a table that can be stored; part is table, weight or bias, name a feature or a layer's number."""
    rows = [("table", f, i, j, float(w)) for f, t in encoder.tables.items() for (i, j), w in np.ndenumerate(t)]
    for n, (w, b) in enumerate(zip(encoder.layers.weights, encoder.layers.biases)):
        rows += [("weight", str(n), i, j, float(x)) for (i, j), x in np.ndenumerate(w)] + [("bias", str(n), 0, j, float(x)) for j, x in enumerate(b)]
    return spark.createDataFrame(rows, "part string, name string, i int, j int, w double")


def load_encoder(weights: DataFrame, categories: list[str]) -> MixedEncoder:
    """The encoder of a stored table, as large as it was trained; a feature without a table is an error."""
    found: dict[tuple[str, str], dict[tuple[int, int], float]] = {}
    for r in weights.select("part", "name", "i", "j", "w").collect():
        found.setdefault((r.part, r.name), {})[r.i, r.j] = r.w

    def matrix(part: str, name: str) -> np.ndarray:
        cells = found[part, name]
        out = np.zeros((1 + max(i for i, _ in cells), 1 + max(j for _, j in cells)))
        for at, w in cells.items():
            out[at] = w
        return out

    if missing := [c for c in categories if ("table", c) not in found]:
        raise ValueError(f"no table for {missing}")
    n = sum(part == "weight" for part, _ in found)
    return MixedEncoder({c: matrix("table", c) for c in categories}, Layers([matrix("weight", str(k)) for k in range(n)], [matrix("bias", str(k))[0] for k in range(n)]))


def encode_mixed(df: DataFrame, keys: list[str], categories: list[FeatureSpec], numbers: dict[str, tuple[float, float]], weights: DataFrame) -> DataFrame:
    """(keys, latent array<double>) of each row: categories as codes, numbers standardised by (mean, std), absent ones 0.

    Nulls and values that a category doesn't know have its null token's code; a code beyond its table is an error.
    Codes and numbers are worked out by built-in functions; Python multiplies matrices of whole batches.
    """
    encoder = load_encoder(weights, [c.name for c in categories])
    for c in categories:
        if max(c.codes.values(), default=0) >= len(encoder.tables[c.name]):
            raise ValueError(f"{c.name} has codes that its table lacks")
    sent = df.sparkSession.sparkContext.broadcast(encoder)
    codes = F.array(*[category_code(F.col(c.name), c).cast("int") for c in categories])
    x = F.array(*[standardised(F.col(c), mean, std).cast("double") for c, (mean, std) in numbers.items()]).cast("array<double>")
    key = F.struct(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                own = batch.column(1).flatten().to_numpy().reshape(n, -1), batch.column(2).flatten().to_numpy().reshape(n, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(sent.value(*own)), pa.list_(pa.float64()))], ["key", "latent"])

    own = df.select(key.alias("key"), codes.alias("codes"), x.alias("x"))
    made = own.mapInArrow(run, StructType([own.schema["key"], StructField("latent", ArrayType(DoubleType()))]))
    return made.select("key.*", "latent")


def non_negative(gram: np.ndarray, target: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """The h >= 0 of least |S h - x|, from S'S and S'x, by the active set: exact after finitely many steps.

    A signature enters while its gradient is over the tolerance; those that the unconstrained solution would make
    negative leave at the boundary. Signatures that depend on others within the set don't enter.
    """
    k = len(target)
    h, held = np.zeros(k), np.zeros(k, dtype=bool)
    scale = tolerance * max(1.0, float(np.abs(target).max(initial=0)))
    barred = np.zeros(k, dtype=bool)
    while True:
        gradient = np.where(held | barred, -np.inf, target - gram @ h)
        best = int(gradient.argmax()) if k else 0
        if not k or gradient[best] <= scale:
            return h
        held[best] = True
        if np.linalg.matrix_rank(gram[np.ix_(held, held)]) < held.sum():
            held[best], barred[best] = False, True
            continue
        while True:
            free = np.zeros(k)
            free[held] = np.linalg.solve(gram[np.ix_(held, held)], target[held])
            if (free[held] > 0).all():
                break
            out = held & (free <= 0)
            step = (h[out] / np.maximum(h[out] - free[out], 1e-300)).min()
            h = h + step * (free - h)
            held &= h > 1e-15 * max(1.0, float(h.max()))
            h[~held] = 0
        h = free
        barred = np.zeros(k, dtype=bool)
        barred[best] = not held[best]  # it left at once, for rounding


def signature_fit(spectra: DataFrame, key: str, channel: str, count: str, signatures: DataFrame) -> DataFrame:
    """(key, activities map<string, double>, total, cosine, l1, l2, gradient) of each spectrum (key, channel, count), by non-negative least squares.

    signatures: the channel and one column for each signature, as a TSV holds them; channels that only one side has count as 0 in
    the other. The gradient is the greatest of what any signature outside the set would still gain, over the total: 0 or less
    where the solution is optimal. Spectra are dealt by key; a spectrum has as many rows as there are channels.
    """
    names = [c for c in signatures.columns if c != channel]
    known = {r[0]: [float(x or 0) for x in r[1:]] for r in signatures.select(channel, *names).collect()}  # a row a channel
    sent = spectra.sparkSession.sparkContext.broadcast(known)
    kind = spectra.schema[key].dataType.simpleString()

    def fit(t: pa.Table) -> pa.Table:
        counts = dict(zip(t.column("channel").to_pylist(), t.column("n").to_pylist()))
        every = sorted(counts.keys() | sent.value.keys())
        x = np.array([counts.get(c) or 0.0 for c in every])
        s = np.array([sent.value.get(c, [0.0] * len(names)) for c in every])
        h = non_negative(s.T @ s, s.T @ x)
        y, total = s @ h, x.sum()
        gradient = float((s.T @ (x - y))[h <= 0].max(initial=0.0)) / max(total, 1.0)
        norm = np.linalg.norm(x) * np.linalg.norm(y)
        cosine = float(x @ y / norm) if norm > 0 else 0.0
        columns = {"key": t.column("key").slice(0, 1), "activities": pa.array([list(zip(names, h.tolist()))], pa.map_(pa.string(), pa.float64()))}
        return pa.table(columns | {k: [float(v)] for k, v in (("total", total), ("cosine", cosine), ("l1", np.abs(x - y).sum()), ("l2", np.linalg.norm(x - y)), ("gradient", gradient))})

    own = spectra.select(F.col(key).alias("key"), F.col(channel).alias("channel"), F.col(count).cast("double").alias("n"))
    schema = f"key {kind}, activities map<string, double>, total double, cosine double, l1 double, l2 double, gradient double"
    return own.groupBy("key").applyInArrow(fit, schema).withColumnRenamed("key", key)
