"""Scores of the three models against plain versions that look at one word, probe or bit after the other."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import WORDS, documents, texts
from pyspark.sql import functions as F

from lociworks.llm import lm, quality_model, toxicity
from lociworks.llm.common import ASCII_LOWER

ALL = 2**64 - 1


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def rows_with_labels() -> list[tuple[str, int]]:
    rng = np.random.default_rng(3)
    return [(" ".join([*rng.choice(WORDS, 40), *(["vile", "VILE!", "$$$"] if i % 2 else ["fine"])]), i % 2) for i in range(120)]


def test_toxicity_is_the_mean_of_subwords(docs):
    model = toxicity.fit(rows_with_labels())
    got = Counter((r.doc_id, round(r.score, 5)) for r in toxicity.score(docs, model).collect())
    want = Counter()
    for i, t in texts():
        total = weight = 0.0
        for w, n in Counter(toxicity.words(t or "")).items():
            for bucket in toxicity.subwords(w):
                total += math.log2(1 + n) * float(model.amounts[bucket])
                weight += math.log2(1 + n)
        z = total / weight if weight else 0.0
        want[i, round(1 / (1 + math.exp(-(model.scale * z + model.shift))), 5)] += 1
    near = lambda c: sorted(((i if i is not None else -1), s) for i, s in c.elements())
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-4 for a, b in zip(near(got), near(want), strict=True))


def test_quality_is_pooling_and_two_layers(docs):
    model = quality_model.fit(rows_with_labels())
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in quality_model.score(docs, model).collect())
    want = []
    for i, t in texts():
        vectors = []
        for w in quality_model.WORD.findall(t or ""):
            at = model.words.get(w, model.shapes.get(quality_model.shape(w)))
            vectors.append([0.0] * quality_model.WIDTH if at is None else [float(x) for x in model.vectors[at]])
        n, width = len(vectors), quality_model.WIDTH
        x = [0.0] * (3 * width + 1)
        if n:
            for k in range(width):
                column = [v[k] for v in vectors]
                mean = sum(column) / n
                steps = [b - a for a, b in zip(column, column[1:])] or [0.0]
                x[k], x[width + k], x[2 * width + k] = mean, math.sqrt(sum((c - mean) ** 2 for c in column) / n), math.sqrt(sum(s * s for s in steps) / len(steps))
            x[-1] = math.log1p(n)
        x = [min(8.0, max(-8.0, (a - m) / s)) for a, m, s in zip(x, model.mean, model.spread)]
        hidden = [math.tanh(sum(a * w for a, w in zip(x, model.layers[0][:, k])) + model.layers[1][k]) for k in range(len(model.layers[1]))]
        z = (sum(h * w for h, w in zip(hidden, model.layers[2])) + model.layers[3][0]) / model.temperature + model.shift
        want.append((i if i is not None else -1, 1 / (1 + math.exp(-z))))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, sorted(want), strict=True))


def mixed(x: int) -> int:
    x = ((x ^ (x >> 32)) * int(lm._LEVEL)) & ALL
    x = ((x ^ (x >> 29)) * int(lm._PAIR)) & ALL
    return x ^ (x >> 32)


def probed(counts: lm.LogFrequencyFilter, h: int) -> float:
    """A quantised count, bit by bit."""
    chunk, each = h >> (65 - counts.chunks.bit_length()), counts.chunks // len(counts.pieces)
    bits, level = counts.pieces[chunk // each].value, 0
    while level < 63:
        a = mixed((h + (level + 1) * int(lm._LEVEL)) & ALL)
        b = mixed(a) | 1
        places = [((a + b * k) & ALL) % counts.chunk_bits + chunk % each * counts.chunk_bits for k in range(lm.PROBES)]
        if not all(bits[p >> 3] >> (p & 7) & 1 for p in places):
            break
        level += 1
    return (0.0, 1.0)[level] if level < 2 else 0.75 * 2**level


def test_scores_are_sums_of_probed_probabilities(spark, docs):
    training = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    model, counts = lm.train(docs, training)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.score) for r in lm.score(docs, model, counts).collect())
    end, cut = int(lm._END), re.compile(r"[^\x20\x09-\x0D]+")
    tokens = lambda t: [*(xxhash.xxh64_intdigest(w.encode()) for w in cut.findall((t or "").translate(ASCII_LOWER))), end]
    pair = lambda v, w: mixed((v * int(lm._PAIR) + w) & ALL)
    one, two = Counter(), Counter()
    for i, t in texts():
        if i is None or i % 7 != 2:
            toks = tokens(t)
            one.update(toks)
            two.update(pair(v, w) for v, w in zip([end, *toks], toks))
    # no count is read too low, and few too high
    exact = [(probed(model.counts, h), n) for seen in (one, two) for h, n in seen.items()]
    level = lambda n: 1.0 if n == 1 else 0.75 * 2 ** n.bit_length()
    assert all(p >= level(n) for p, n in exact) and np.mean([p == level(n) for p, n in exact]) > 0.97
    want, known = [], {}
    read = lambda h: known.setdefault(h, probed(model.counts, h))
    for i, t in texts():
        toks, total = tokens(t), 0.0
        for v, w in zip([end, *toks], toks):
            p = lm.SHARE * min(1.0, read(pair(v, w)) / max(read(v), 1.0)) + (1 - lm.SHARE) * (read(w) + 1) / (model.n + model.v + 1)
            total += math.log10(p)
        want.append((i if i is not None else -1, total))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-6 * max(1, abs(b[1])) for a, b in zip(got, sorted(want), strict=True))
