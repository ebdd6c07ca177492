"""Toxicity by subword-bag embeddings (operator 1).

A word is a bag of hashed character n-grams and itself; a text is the average
of the vectors of all its subwords, which a linear softmax classifies. A word
that is repeated n times weighs log2(1 + n). Vectors
and softmax are trained together in numpy on a bounded sample of labelled rows
(at most ``SAMPLE`` of each label). Misspelt words that training never saw
share n-grams, and so vectors, with the words they stand for. A part of the
sample, kept from training, sets scale and shift of the probabilities.

Since the classifier is linear, a subword adds a fixed amount to the logit; each
distinct word's amount is worked out once per worker. Texts are scored whole.
Labels, language, source and id are never inputs of a score.

Null and empty texts, and texts without words, have the average of no subword,
the zero vector, and get the score of the shift alone. Repeated rows give
repeated results. Without labels of both kinds every score is the share of
label 1 in the sample (0 if it is empty). Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, held_out, table, text_slices
from .labelled import Adam, WordValues, calibrated, probability, sample, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Rows of each label that are trained on at most.
SAMPLE = {0: 2500, 1: 1500}
BUCKETS, WIDTH, SHORTEST, LONGEST = 1 << 15, 8, 3, 5
EPOCHS, BATCH, RATE, DECAY = 10, 128, 0.05, 1e-5
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5


def words(text: str) -> list[str]:
    return WORD.findall(text.translate(ASCII_LOWER))


def subwords(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, with marks at both ends."""
    crc, mask = zlib.crc32, BUCKETS - 1
    if word.isascii():
        w = b"<%b>" % word.encode()
        out = [crc(w[i : i + n]) & mask for n in range(SHORTEST, LONGEST + 1) for i in range(len(w) - n + 1)]
    else:
        s = f"<{word}>"
        w = s.encode("utf-8", "surrogatepass")
        out = [crc(s[i : i + n].encode("utf-8", "surrogatepass")) & mask for n in range(SHORTEST, LONGEST + 1) for i in range(len(s) - n + 1)]
    out.append(crc(w, 1) & mask)
    return out


@dataclass
class Model:
    """What is sent to the tasks: each bucket's amount of logit, and scale and shift. Its size is fixed."""

    amounts: np.ndarray
    scale: float
    shift: float


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct subwords of each text and the share of each."""
    seen: dict[str, np.ndarray] = {}
    out = []
    for text in texts:
        counts = Counter(words(text))
        for w in counts:
            if w not in seen:
                seen[w] = np.array(subwords(w), dtype=np.int32)
        if not counts:
            out.append((np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)))
            continue
        ids = np.concatenate([seen[w] for w in counts])
        times = np.repeat(np.log2(1.0 + np.array(list(counts.values()))), [len(seen[w]) for w in counts])
        n = np.bincount(ids, weights=times, minlength=BUCKETS)
        at = np.flatnonzero(n)
        out.append((at.astype(np.int32), (n[at] / n.sum()).astype(np.float32)))
    return out


def fit(rows: list[tuple[str, int]], of_all: float | None = None, seed: int = 1) -> Model:
    """Trains vectors and softmax together by Adam on minibatches. of_all: the share of label 1 among the rows that these were drawn from."""
    y = np.array([label for _, label in rows], dtype=np.float32)
    if len(set(y.tolist())) < 2:
        only = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS, dtype=np.float32), 1.0, float(np.log(max(only, 1e-9) / max(1 - only, 1e-9))))
    bags = _bags([text for text, _ in rows])
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    own, rest = split(len(rows))
    steps = [Adam(RATE), Adam(RATE), Adam(RATE)]
    balance = np.array([0.5 / max(1e-9, 1 - y[own].mean()), 0.5 / max(1e-9, y[own].mean())], dtype=np.float32)
    for epoch in range(EPOCHS):
        order = rng.permutation(own)
        for at in range(0, len(order), BATCH):
            batch = [i for i in order[at : at + BATCH] if len(bags[i][0])]
            if not batch:
                continue
            ids, share = np.concatenate([bags[i][0] for i in batch]), np.concatenate([bags[i][1] for i in batch])
            sizes = np.array([len(bags[i][0]) for i in batch])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[ids] * share[:, None], starts)
            z = mean @ weights + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            labels = y[batch].astype(int)
            p[np.arange(len(batch)), labels] -= 1
            p *= balance[labels][:, None] / len(batch)
            back = np.repeat(p @ weights.T, sizes, axis=0) * share[:, None]
            g = np.stack([np.bincount(ids, weights=back[:, k], minlength=BUCKETS) for k in range(WIDTH)], axis=1).astype(np.float32)
            steps[0].step(vectors, g + DECAY * vectors)
            steps[1].step(weights, mean.T @ p)
            steps[2].step(bias, p.sum(0))
    amounts = vectors @ (weights[:, 1] - weights[:, 0])
    rest = rest if len(set(y[rest].tolist())) == 2 else np.arange(len(rows))
    z = np.array([float((amounts[bags[i][0]] * bags[i][1]).sum()) for i in rest])
    scale, shift = calibrated(z, y[rest], of_all)
    return Model(amounts.astype(np.float32), scale, shift)


class Scorer:
    def __init__(self, model: Model):
        self._model = model
        self._values = WordValues(2, self._amounts)

    def _amounts(self, new: list[str]) -> np.ndarray:
        bags = [subwords(w) for w in new]
        sizes = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
        flat = self._model.amounts[np.fromiter((i for b in bags for i in b), dtype=np.int64, count=int(sizes.sum()))]
        return np.stack([np.add.reduceat(flat, np.concatenate([[0], np.cumsum(sizes)[:-1]])), sizes], axis=1).astype(np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        cut = [Counter(words(t or "")) for t in texts]
        self._values.learn(cut)
        z = np.zeros(len(texts))
        for i, counts in enumerate(cut):
            if counts:
                times = np.log2(1.0 + np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
                total, n = times @ self._values.of(counts)
                z[i] = total / n
        return probability(self._model.scale * z + self._model.shift)


_READY: dict[int, Scorer] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(sent.value.amounts.tobytes())
        if key not in _READY:
            _READY.clear()
            _READY[key] = Scorer(sent.value)
        scorer = _READY[key]
        for batch in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(batch.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*sample(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
