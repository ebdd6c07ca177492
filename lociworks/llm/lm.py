"""Language-model scoring with a log-frequency Bloom filter (operator 3).

The model holds quantised counts of n-grams, here single tokens and pairs of
neighbours: an n-gram with count c is put into a Bloom filter with each of the
levels 1 .. 1 + floor(log2 c), and its count is read back by probing levels from
1 until one is absent. Probabilities are smoothed by interpolation:

    p(w | v) = SHARE * min(1, count(v w) / count(v)) + (1 - SHARE) * (count(w) + 1) / (N + V + 1)

Counting covers all training documents, and all their tokens and pairs enter the
filter, those of count 1 too. Its size follows the number of its items, so false
positives keep their rate however large the corpus grows. It is built in chunks
by the top bits of the hash. N-grams are dealt to tasks by these bits, a part as
one row of packed hashes and counts, and added up there; the number of parts follows theirs. The filter is sent in
pieces of at most PIECE_BITS: the driver holds one piece at a time. A task
holds all pieces if they are HELD_BITS at most; beyond that it reads one after
the other for each slice of texts, and each n-gram is probed in its piece.

A token is its 64-bit hash throughout: two tokens of one hash would be one.

The plain base score needs exact counts of all tokens. Counts of the HEAD most
frequent ones are broadcast, which bounds that side and takes the frequent
tokens out of the shuffle; each document's other tokens are joined to the
counts by a shuffle on the token's 64-bit hash.

Null and empty texts have one token, the end. Repeated rows give repeated
results and, outside the held-out fold, count repeatedly. Without training
documents N and V are 0 and all tokens unknown. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, held_out, table, text_slices

#: Most tokens whose exact counts are broadcast.
HEAD = 500_000
#: Bits of the filter for each item that is put in, at least; probes for each item.
BITS_PER_ITEM, PROBES = 10, 5
#: Bits of a piece of the filter that is sent at once, and of those that a task holds at a time, at most.
PIECE_BITS, HELD_BITS = 1 << 28, 1 << 30
#: Chunks of a small filter; parts in which n-grams are dealt out, at least, of which a filter of more than SMALL_BITS has as many chunks.
CHUNKS, PARTS, SMALL_BITS = 256, 4096, 1 << 26
#: N-grams of a part, on average at most, counted with all their occurrences; a task adds up one part at a time.
PART_GRAMS = 1 << 21
SHARE = 0.3
FOLDS, HELD_OUT = 7, 2
#: Bytes of text that a task scores at a time.
SLICE = 2 << 20
#: Entries that a counting task gathers before it passes them on.
GATHER = 1 << 20

_END = np.uint64(0x9E3779B97F4A7C15)  # the end token's hash; no word has the empty text
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_LEVEL = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * _LEVEL
    x = (x ^ (x >> np.uint64(29))) * _PAIR
    return x ^ (x >> np.uint64(32))


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, and how many each text has; every text closes with the end.

    Bytes are lower-cased and cut as ASCII has it: A-Z, and blanks and 9 to 13.
    """
    cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)) + 1
    flat = hashes([w for c in cut for w in c])
    out = np.full(int(sizes.sum()), _END, dtype=np.uint64)
    ends = np.cumsum(sizes) - 1
    inside = np.ones(len(out), dtype=bool)
    inside[ends] = False
    out[inside] = flat
    return out, sizes


def pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring tokens."""
    return mixed(first * _PAIR + second)


def preceding(toks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token the one before it, for the first of a text the end."""
    out = np.empty_like(toks)
    out[1:] = toks[:-1]
    out[np.cumsum(sizes) - sizes] = _END
    return out


_PACKED = "part int, h binary, n binary"


def _rows(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def parts_for(grams: int) -> int:
    """In how many parts so many n-grams are dealt out: a power of two that follows their number."""
    return max(PARTS, 1 << max(0, -(-grams // PART_GRAMS) - 1).bit_length())


def _packed(h: np.ndarray, n: np.ndarray, dealt: int = PARTS) -> pa.RecordBatch:
    """One row for each part of n-grams in order: their hashes, and their counts, as bytes."""
    parts, at = np.unique(chunk_of(h, dealt), return_index=True)
    ends = [*at[1:], len(h)]
    bytes_of = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), bytes_of(h), bytes_of(n.astype(np.int64))], ["part", "h", "n"])


def _added(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram once, in order, with the sum of its counts."""
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
    return h[first], np.add.reduceat(n, first) if len(h) else n


def _counting(batches: Iterable[pa.RecordBatch], grams, told=_rows) -> Iterator[pa.RecordBatch]:
    """What told makes of the hashes that grams makes of token arrays, added up over about GATHER entries at a time."""
    held, size = [], 0
    for batch in text_slices(batches, limit=SLICE):
        toks, sizes = tokens(batch.column(0).to_pylist())
        held.append(grams(toks, sizes))
        size += len(held[-1])
        if size > GATHER:
            yield told(*np.unique(np.concatenate(held), return_counts=True))
            held, size = [], 0
    if held:
        yield told(*np.unique(np.concatenate(held), return_counts=True))


def packed(grams: DataFrame, dealt: int = PARTS) -> DataFrame:
    """Rows (h, n) in parts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size > GATHER:
                yield _packed(*_added(*map(np.concatenate, zip(*held))), dealt)
                held, size = [], 0
        if held:
            yield _packed(*_added(*map(np.concatenate, zip(*held))), dealt)

    return grams.select("h", "n").mapInArrow(run, _PACKED)


def merged(parts: DataFrame) -> DataFrame:
    """(part, items, h, top), checkpointed: of each part all n-grams once, their levels, and the sum of these."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3))))
        for part, own in groupby(rows, key=lambda row: row[0]):
            own = list(own)
            h, n = _added(np.frombuffer(b"".join(r[1] for r in own), dtype=np.uint64), np.frombuffer(b"".join(r[2] for r in own), dtype=np.int64))
            top = levels(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([int(top.sum())]),
                    pa.array([h.tobytes()], pa.binary()),
                    pa.array([top.astype(np.uint8).tobytes()], pa.binary()),
                ],
                ["part", "items", "h", "top"],
            )

    return checkpointed(parts.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, items long, h binary, top binary"))


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, n) of every token of a one-column table of texts."""
    return texts.mapInArrow(lambda b: _counting(b, lambda toks, _: toks), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def cut_off(counts: DataFrame, most: float, weight=None) -> int:
    """The least count c such that n-grams of count c or more weigh at most ``most`` together.

    Works on a histogram of counts, exact below 4096 and by 1/64 powers of two above.
    """
    n = F.col("n")
    level = F.when(n < 4096, n).otherwise(F.ceil(F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")) * 64) / 64)).cast("long"))
    sums = counts.groupBy(level.alias("c")).agg(F.sum(F.lit(1) if weight is None else weight).alias("w")).collect()
    total, least = 0, None
    for c, w in sorted(((r["c"], r["w"]) for r in sums), reverse=True):
        total += w
        if total > most:
            break
        least = c
    return least if least is not None else 1 << 62


def levels(n: np.ndarray) -> np.ndarray:
    """1 + floor(log2 n)."""
    return np.frexp(n.astype(np.float64))[1].astype(np.int64)


def chunk_of(h: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of each n-gram: the top bits of its hash. chunks is a power of two."""
    return (h >> np.uint64(65 - chunks.bit_length())).astype(np.int64)


def filter_bits(h: np.ndarray, level: np.ndarray | int, chunk_bits: int) -> np.ndarray:
    """PROBES places of each n-gram in its chunk for a level. chunk_bits is a power of two."""
    a = mixed(h + np.asarray(level).astype(np.uint64) * _LEVEL)
    b = mixed(a) | np.uint64(1)
    with np.errstate(over="ignore"):
        places = (a[:, None] + b[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(chunk_bits - 1)
    return places.astype(np.int64)


class LogFrequencyFilter:
    """Reads quantised counts from the bits. pieces: broadcast, each of the same number of neighbouring chunks."""

    def __init__(self, pieces: list[Broadcast], chunks: int, chunk_bits: int):
        self.pieces, self.chunks, self.chunk_bits = pieces, chunks, chunk_bits

    def _levels(self, bits: np.ndarray, first: int, kinds: np.ndarray) -> np.ndarray:
        """The highest level of each n-gram of a piece that begins with chunk first."""
        top = np.zeros(len(kinds), dtype=np.int64)
        left = np.arange(len(kinds))
        for level in range(1, 64):
            places = filter_bits(kinds[left], level, self.chunk_bits)
            places += ((chunk_of(kinds[left], self.chunks) - first) * self.chunk_bits)[:, None]
            there = (bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).all(1)
            left = left[there]
            if not len(left):
                break
            top[left] = level
        return top

    def count(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the middle of the range of counts of its highest level; 0 if it isn't there."""
        kinds, inverse = np.unique(h, return_inverse=True)
        top = np.zeros(len(kinds), dtype=np.int64)
        each = self.chunks // len(self.pieces)
        # n-grams are in order, so those of a piece stand together
        at = np.searchsorted(chunk_of(kinds, self.chunks), np.arange(0, self.chunks + 1, each))
        held = self.chunks * self.chunk_bits <= HELD_BITS
        for k, piece in enumerate(self.pieces):
            if at[k] < at[k + 1]:
                top[at[k] : at[k + 1]] = self._levels(piece.value, k * each, kinds[at[k] : at[k + 1]])
                if not held:
                    vars(piece).pop("_value", None)  # it is read from the executor's disk again when it is needed
        return np.where(top > 0, 0.75 * 2.0**top, 0.0)[inverse] - 0.5 * (top == 1)[inverse]


def build_filter(grams: DataFrame, items: int) -> LogFrequencyFilter:
    """The filter of n-grams (h, n), which have so many levels together."""
    return filter_of(merged(packed(grams)), items)


def filter_of(parts: DataFrame, items: int, dealt: int = PARTS) -> LogFrequencyFilter:
    """The filter of merged parts, of which so many were dealt. A chunk is built in memory of its size."""
    bits = max(1 << 16, 1 << (items * BITS_PER_ITEM).bit_length())
    chunks = CHUNKS if bits <= SMALL_BITS else dealt
    pieces = min(chunks, max(1, bits // PIECE_BITS))
    chunk_bits = bits // chunks

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(3))))
        for c, own in groupby(rows, key=lambda row: row[0] * chunks // dealt):
            out = np.zeros(chunk_bits // 8, dtype=np.uint8)
            for _, h, top in own:
                h, top = np.frombuffer(h, dtype=np.uint64), np.frombuffer(top, dtype=np.uint8)
                for level in range(1, int(top.max(initial=0)) + 1):
                    p = filter_bits(h[top >= level], level, chunk_bits).ravel()
                    np.bitwise_or.at(out, p >> 3, (1 << (p & 7)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["chunk", "bits"])

    made = checkpointed(parts.select("part", "h", "top").mapInArrow(run, "chunk long, bits binary"))
    sent, each = [], chunks // pieces
    for first in range(0, chunks, each):
        out = np.zeros(each * chunk_bits // 8, dtype=np.uint8)
        for c, own in made.where(F.col("chunk").between(first, first + each - 1)).collect():  # PIECE_BITS together
            at = (c - first) * (chunk_bits // 8)
            out[at : at + chunk_bits // 8] |= np.frombuffer(own, dtype=np.uint8)
        piece = parts.sparkSession.sparkContext.broadcast(out)
        vars(piece).pop("_value", None)  # only tasks read it, so the driver keeps no copy
        sent.append(piece)
    return LogFrequencyFilter(sent, chunks, chunk_bits)


class Model:
    """What the tasks get: the filter, N, V, and exact counts of the most frequent tokens by their hashes."""

    def __init__(self, counts: LogFrequencyFilter, n: int, v: int, head: np.ndarray, head_counts: np.ndarray):
        self.counts, self.n, self.v, self.head, self.head_counts = counts, n, v, head, head_counts


def _sorted_arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def train(docs: DataFrame, training) -> tuple[Model, DataFrame]:
    """The model of the documents for which the column training is true, and exact counts (h, n) of all their tokens."""
    texts = docs.where(training).select(F.col("text").cast("string").alias("text"))
    counts = checkpointed(token_counts(texts))
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _sorted_arrays(counts.where(F.col("n") >= cut_off(counts, HEAD)))
    near = lambda toks, sizes: pairs(preceding(toks, sizes), toks)
    dealt = parts_for(2 * int(n))  # tokens and pairs
    parts = merged(packed(counts, dealt).unionAll(texts.mapInArrow(lambda b: _counting(b, near, lambda h, n: _packed(h, n, dealt)), _PACKED)))
    items = parts.agg(F.coalesce(F.sum("items"), F.lit(0))).first()[0]
    return Model(filter_of(parts, int(items), dealt), int(n), int(v), *head), counts


def _add_up(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


_RARE = "array<struct<h: bigint, times: bigint>>"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every document row."""
    grams, n, v = model.counts, model.n, model.v
    sent = docs.sparkSession.sparkContext.broadcast((model.head, model.head_counts))
    unseen = -float(np.log10(model.n + model.v + 1))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, head_counts = sent.value
        for batch in text_slices(batches, limit=SLICE):
            toks, sizes = tokens(batch.column(1).to_pylist())
            before = preceding(toks, sizes)
            # all at once, so each piece of the filter is read once
            one, two, ends = np.split(grams.count(np.concatenate([toks, pairs(before, toks), [_END]])), [len(toks), 2 * len(toks)])
            ahead = np.maximum(np.concatenate([[0.0], one[:-1]]) if len(one) else one, 1.0)
            ahead[np.cumsum(sizes) - sizes] = max(ends[0], 1.0)
            p = SHARE * np.minimum(1.0, two / ahead) + (1 - SHARE) * (one + 1) / (n + v + 1)
            at = np.minimum(np.searchsorted(head, toks), max(0, len(head) - 1))
            in_head = head[at] == toks if len(head) else np.zeros(len(toks), dtype=bool)
            exact = np.where(in_head, head_counts[at] if len(head) else 0, 0)
            base = np.log10(exact + 1.0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rare = pd.DataFrame({"doc": owner[~in_head], "h": toks[~in_head].view(np.int64)}).groupby(["doc", "h"], sort=True).size()
            docs_of, h = (rare.index.get_level_values(k).to_numpy() for k in (0, 1))
            offsets = np.searchsorted(docs_of, np.arange(len(sizes) + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(
                pa.array(offsets),
                pa.StructArray.from_arrays([pa.array(h.astype(np.int64)), pa.array(rare.to_numpy().astype(np.int64))], ["h", "times"]),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(sizes),
                    pa.array(_add_up(in_head.astype(np.int64), sizes).astype(np.int64)),
                    pa.array(_add_up(base, sizes).astype(np.float64)),
                    pa.array(_add_up(np.log10(p), sizes).astype(np.float64)),
                    listed,
                ],
                ["doc_id", "n_tokens", "in_head", "head_log", "score", "rare"],
            )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = checkpointed(own.mapInArrow(
        run,
        f"doc_id long, n_tokens long, in_head long, head_log double, score double, rare {_RARE}",
    ).withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.times")
    known = rare.join(counts, "h").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_log"))
    both = scored.drop("rare").join(known, "row", "left")
    base = F.col("head_log") + F.coalesce("more_log", F.lit(0.0)) + F.col("n_tokens") * F.lit(unseen)
    return both.select("doc_id", "n_tokens", (F.col("in_head") + F.coalesce("more", F.lit(0))).alias("n_known"), base.alias("base_score"), "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a model of those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), FOLDS, HELD_OUT)
    model, counts = train(docs, F.coalesce(~out, F.lit(True)))
    scored = score(docs, model, counts)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
