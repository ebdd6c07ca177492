"""Quality classifier: random indexing and a small network (operator 8).

Every word has a fixed sparse index vector. A word's vector is the average, over
its places in a bounded labelled sample, of the index vectors of the words
around it and of the shapes of these and of itself; of the words of the sample
the ``VOCABULARY`` most frequent are kept. A word beyond them has the vector of
its shape: letters, digits and marks with runs written once. A text is pooled
as mean and spread of its words' vectors, and of how they follow each other. A
network of two layers, trained in numpy, scores it; a temperature, fitted on
rows kept from training, calibrates the probabilities.

The model has a fixed size and is broadcast; texts are scored whole. Labels,
language, source and id are never inputs of a score.

Null and empty texts, and texts without words, are pooled as zeros and scored
like any other. Repeated rows give repeated results. Without labels of both
kinds every score is the share of label 1 in the sample (0 if it is empty).
Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table, text_slices
from .labelled import Adam, WordValues, probability, sample, split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows of each label that are trained on at most.
SAMPLE = {0: 2000, 1: 3000}
VOCABULARY, WIDTH, ONES, REACH = 20_000, 48, 6, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 0.004, 1e-4
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

_CLASSES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "X"), (re.compile(r"[a-zß-öø-ÿ]+"), "x"), (re.compile(r"[0-9]+"), "0")]
_MARKS = re.compile(r"([^Xx0])\1+")


def shape(word: str) -> str:
    """A word with runs of capitals, small letters, digits and equal marks written once."""
    for pattern, sign in _CLASSES:
        word = pattern.sub(sign, word)
    return _MARKS.sub(r"\1\1", word)[:12]


def index_vector(word: str) -> np.ndarray:
    """The fixed sparse vector of a word: ONES places hold 1 or -1."""
    out, h = np.zeros(WIDTH, dtype=np.float32), xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 11)
    for _ in range(ONES):
        h, place = divmod(h, WIDTH)
        h, sign = divmod(h, 2)
        out[place] += 1 - 2 * sign
    return out


@dataclass
class Model:
    words: dict[str, int]
    shapes: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    shift: float


def random_indexing(texts: list[list[str]]) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    """Vectors of the most frequent words and of all shapes of some texts."""
    counts = Counter(w for t in texts for w in t)
    kept = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY])}
    form = {w: shape(w) for w in counts}
    shapes = {s: len(kept) + i for i, s in enumerate(sorted(set(form.values())))}
    kind = {w: i for i, w in enumerate(counts)}
    index = np.stack([index_vector(w) + index_vector("shape " + form[w]) for w in kind]) if kind else np.zeros((0, WIDTH), dtype=np.float32)
    own = np.stack([index_vector("own " + form[w]) for w in kind]) if kind else index
    total = np.zeros((len(kind), WIDTH), dtype=np.float64)
    for t in texts:
        ids = np.array([kind[w] for w in t], dtype=np.int64)
        around = own[ids].astype(np.float64)
        for k in range(1, min(REACH, len(ids) - 1) + 1):
            around[k:] += index[ids[:-k]]
            around[:-k] += index[ids[k:]]
        np.add.at(total, ids, around)
    vectors = np.zeros((len(kept) + len(shapes), WIDTH))
    times = np.zeros(len(vectors))
    for w, i in kind.items():
        n = counts[w]
        for at in {kept.get(w), shapes[form[w]]} - {None}:
            vectors[at] += total[i]
            times[at] += n
    return kept, shapes, (vectors / np.maximum(times, 1)[:, None]).astype(np.float32)


def pooled(v: np.ndarray) -> np.ndarray:
    """One row for the vectors of a text's words: mean, spread, and spread of the steps from word to word."""
    if not len(v):
        return np.zeros(3 * v.shape[1] + 1, dtype=np.float32)
    steps = np.diff(v, axis=0) if len(v) > 1 else np.zeros_like(v)
    return np.concatenate([v.mean(0), v.std(0), np.sqrt((steps * steps).mean(0)), [np.log1p(len(v))]]).astype(np.float32)


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3]


def fit(rows: list[tuple[str, int]], of_all: float | None = None, seed: int = 1) -> Model:
    """Trains vectors, network and temperature. of_all: the share of label 1 among the rows that these were drawn from."""
    y = np.array([label for _, label in rows], dtype=np.float64)
    texts = [WORD.findall(text) for text, _ in rows]
    kept, shapes, vectors = random_indexing(texts)
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        size = 3 * WIDTH + 1
        return Model(
            kept,
            shapes,
            vectors,
            np.zeros(size),
            np.ones(size),
            [np.zeros((size, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)],
            1.0,
            float(np.log(p / (1 - p))),
        )
    model = Model(kept, shapes, vectors, np.zeros(0), np.zeros(0), [], 1.0, 0.0)
    x = Scorer(model).pool(texts)
    own, rest = split(len(rows))
    model.mean, model.spread = x[own].mean(0), x[own].std(0) + 1e-3
    x = np.clip((x - model.mean) / model.spread, -8, 8)
    size = x.shape[1]
    layers = [rng.normal(0, size**-0.5, (size, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    steps = [Adam(RATE) for _ in layers]
    for _ in range(EPOCHS):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            b = order[at : at + BATCH]
            hidden, z = forward(x[b], layers)
            d = (probability(z) - y[b]) / len(b)
            inner = np.outer(d, layers[2]) * (1 - hidden * hidden)
            for step, layer, g in zip(steps, layers, [x[b].T @ inner + DECAY * layers[0], inner.sum(0), hidden.T @ d + DECAY * layers[2], np.array([d.sum()])]):
                step.step(layer, g)
    model.layers = layers
    z = forward(x[rest], layers)[1]
    model.temperature = temperature(z, y[rest])
    drawn = float(y.mean())
    if of_all and 0 < of_all < 1:
        model.shift = float(np.log(of_all / (1 - of_all)) - np.log(drawn / (1 - drawn)))
    return model


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, by search over a grid of powers."""
    grid = 2.0 ** np.arange(-3, 5, 0.125)
    loss = [np.mean(np.logaddexp(0, -(2 * y - 1) * z / t)) if len(z) else 0.0 for t in grid]
    return float(grid[int(np.argmin(loss))]) if len(z) else 1.0


class Scorer:
    def __init__(self, model: Model):
        self._model = model
        self._values = WordValues(WIDTH, self._vectors, remember=200_000)

    def _vectors(self, new: list[str]) -> np.ndarray:
        words, shapes = self._model.words, self._model.shapes
        at = [words[w] if w in words else shapes.get(shape(w), -1) for w in new]
        out = self._model.vectors[np.array(at)] if len(self._model.vectors) else np.zeros((len(new), WIDTH), dtype=np.float32)
        out[np.array(at) < 0] = 0
        return out

    def pool(self, texts: list[list[str]]) -> np.ndarray:
        self._values.learn(texts)
        return np.stack([pooled(self._values.of(t)) for t in texts]) if texts else np.zeros((0, 3 * WIDTH + 1), dtype=np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        m = self._model
        x = np.clip((self.pool([WORD.findall(t or "") for t in texts]) - m.mean) / m.spread, -8, 8)
        return probability(forward(x, m.layers)[1] / m.temperature + m.shift)


_READY: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((sent.value.vectors.tobytes(), sent.value.shift))
        if key not in _READY:
            _READY.clear()
            _READY[key] = Scorer(sent.value)
        scorer = _READY[key]
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
