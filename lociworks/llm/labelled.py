"""What the two classifiers share: bounded labelled samples, calibration, and a cache of word values."""

from __future__ import annotations

import math
from collections.abc import Callable, Collection, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Texts past this many characters are not trained on, which bounds what a sample weighs. They are scored like any other.
SAMPLE_CHARS = 20_000
#: See calibrated().
PRIOR = 0.5


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: dict[int, int]) -> tuple[list[tuple[str, int]], float]:
    """The share of label 1 among all labelled rows outside the held-out fold, and a sample of them: at most most[y] (text, y) for each label y, from rows outside the held-out fold, in the order of their ids' hashes.

    Rows without a label, an id or a text are left out; an id labelled twice has its larger label.
    """
    known = labels.where(F.col(label).isin(*most) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    fit = docs.where(F.char_length("text") <= SAMPLE_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.join(fit.distinct(), "doc_id", "left_semi")
    chosen = None
    for y, n in most.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.char_length("text") <= SAMPLE_CHARS)
    met = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    return [(r["text"], r["y"]) for r in sorted(met.collect(), key=lambda r: r["doc_id"])], share or 0.0


def calibrated(z: np.ndarray, y: np.ndarray, share: float | None = None) -> tuple[float, float]:
    """(scale, shift) of the logits z that make scale * z + shift likeliest for the labels y.

    share: how many of the rows that y was drawn from have label 1, if y has been drawn unevenly. The shift
    goes PRIOR of the way from the drawn odds to those: all of it is likeliest, less of it misses fewer rare rows.
    """
    mean, spread = float(z.mean()), float(z.std()) or 1.0
    x, target = (z - mean) / spread, y * (1 - 2e-3) + 1e-3
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        ga, gb = ((p - target) * x).mean() + 1e-4 * a, (p - target).mean()
        haa, hab, hbb = (w * x * x).mean() + 1e-4, (w * x).mean(), w.mean() + 1e-6
        det = haa * hbb - hab * hab + 1e-12
        a, b = a - np.clip((hbb * ga - hab * gb) / det, -1, 1), b - np.clip((haa * gb - hab * ga) / det, -1, 1)
    drawn = float(y.mean())
    if share and 0 < share < 1 and 0 < drawn < 1:
        b += PRIOR * (math.log(share / (1 - share)) - math.log(drawn / (1 - drawn)))
    return float(a / spread), float(b - a * mean / spread)


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class WordValues:
    """A row of numbers for each distinct word, worked out once per worker in a bounded table."""

    def __init__(self, width: int, make: Callable[[list[str]], np.ndarray], remember: int = 400_000):
        self._make, self._remember = make, remember
        self._at: dict[str, int] = {}
        self.rows = np.zeros((0, width), dtype=np.float32)

    def learn(self, texts: Iterable[Collection[str]]) -> None:
        texts = list(texts)
        new = set().union(*texts).difference(self._at)
        if self._at and len(self._at) + len(new) > self._remember:
            self._at, self.rows = {}, self.rows[:0]
            new = set().union(*texts)
        if new:
            words = sorted(new)
            self._at.update(zip(words, range(len(self._at), len(self._at) + len(words))))
            self.rows = np.concatenate([self.rows, self._make(words)])

    def of(self, words: Collection[str]) -> np.ndarray:
        return self.rows[np.fromiter(map(self._at.__getitem__, words), dtype=np.int64, count=len(words))]


def split(n: int, share: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Indices to fit on and to calibrate on."""
    order = np.random.default_rng(7).permutation(n)
    k = math.ceil(n * (1 - share))
    return order[:k], order[k:]


class Adam:
    """Steps for one array of parameters."""

    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, None, None

    def step(self, x: np.ndarray, g: np.ndarray) -> None:
        if self.m is None:
            self.m, self.v = np.zeros_like(x), np.zeros_like(x)
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        x -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)
