"""Byte-level BPE encoding and decoding (operator 4).

Each short pre-token is a contiguous pair of lists, the parts left so far and
the merge ranks of adjacent parts. The encoder scans for the least rank,
deletes that boundary and refreshes the two neighbouring ranks, until no
adjacent pair can be merged. Pre-tokens past ``SHORT`` bytes, where the scan
would be quadratic, pop the same merges from a heap over linked parts.

Ranks are looked up by the pair of parts, as the vocabulary's merge list has
them, so ids agree with the tokenizers library. Pre-tokens are split by the
installed Unicode tables, which may differ from that library's for code points
that are newer than either.

Null or empty text: no ids. Repeated rows: repeated results. Texts of any
length are encoded whole. Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_slices, vocabulary_bytes

#: How byte-level vocabularies of this kind cut texts (a fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a pre-token is merged by scanning.
SHORT = 128
#: Distinct words, and pre-tokens, in each of the two generations that a worker remembers; bytes of text that it encodes at a time.
REMEMBER, SLICE = 100_000, 2 << 20
#: White space other than the blank, after which words may not be cut apart.
_SPACES = [*map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]

_INF = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in such vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [symbols[b] for b in range(256)]


class Remembered(dict):
    """A bounded cache: when it is full, its entries become the older generation and the former one goes."""

    def __init__(self, make):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        if len(key) <= SHORT and "\n" not in key:
            if len(self) >= REMEMBER:
                self._older = dict(self)
                self.clear()
            self[key] = value
        return value


class RankArrayBpe:
    """One vocabulary, ready to encode and decode."""

    def __init__(self, tokenizer_json: bytes):
        spec = json.loads(tokenizer_json)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {s: b for b, s in enumerate(symbols)}
        self.byte_id = [vocab[s] for s in symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a] << 32 | vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.piece = [b""] * size
        for s, i in vocab.items():
            self.piece[i] = bytes(to_byte[c] for c in s)
        for s, i in self.special.items():
            self.piece[i] = s.encode()
        self._find = regex.compile(PRETOKEN).findall
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._pretoken = Remembered(lambda word: np.array(self.merge(word.encode()), dtype="<u4").tobytes())
        self._word = Remembered(lambda word: b"".join(map(self._pretoken.__getitem__, self._find(" " + word))))

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        byte_id, get, merged = self.byte_id, self.rank.get, self.merged
        parts = [byte_id[b] for b in word]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        ranks = [get(a << 32 | b, _INF) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == _INF:
                break
            i = ranks.index(least)
            parts[i] = merged[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], _INF)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], _INF)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        get, merged, n = self.rank.get, self.merged, len(parts)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := get(a << 32 | b, _INF)) < _INF]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = merged[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(parts[i] << 32 | parts[k], _INF)) < _INF:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := get(parts[h] << 32 | parts[i], _INF)) < _INF:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def _ordinary(self, text: str, out: list[bytes]) -> None:
        """Cuts before blanks first: with no white space after it, a blank always begins a pre-token."""
        if any(" " + s in text for s in _SPACES):
            out += map(self._pretoken.__getitem__, self._find(text))
        else:
            first, *rest = text.split(" ")
            out += map(self._pretoken.__getitem__, self._find(first))
            out += map(self._word.__getitem__, rest)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers. Special tokens in the text keep their ids."""
        out: list[bytes] = []
        if self._cut is None or not any(s in text for s in self.special):
            self._ordinary(text, out)
        else:
            for part in self._cut.split(text):
                if part in self.special:
                    out.append(np.array([self.special[part]], dtype="<u4").tobytes())
                elif part:
                    self._ordinary(part, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; invalid sequences become U+FFFD."""
        piece = self.piece
        raw = b"".join([piece[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_READY: dict[int, RankArrayBpe] = {}


def _ready(sent) -> RankArrayBpe:
    """This worker's copy of a broadcast vocabulary, with what it remembers."""
    key = hash(sent.value)
    if key not in _READY:
        _READY[key] = RankArrayBpe(sent.value)
    return _READY[key]


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: (id, n_tokens, ids array<int>)."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary or _default_path()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(sent)
        for batch in text_slices(batches, SLICE):
            raw = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            counts = np.array([len(r) // 4 for r in raw], dtype=np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), ids)], ["id", "n_tokens", "ids"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of token ids: (id, text). Null ids give the empty text; an id outside the vocabulary gives nothing."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary or _default_path()))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(sent)
        for batch in batches:
            texts = [bpe.decode(np.array(
                [i for i in ids or () if i is not None and 0 <= i < len(bpe.piece)],
                dtype="<u4",
            ).tobytes()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each text encoded, its ids decoded again, and digests of both in one pass over the texts."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary or _default_path()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _ready(sent)
        sha = hashlib.sha256
        for batch in text_slices(batches, SLICE):
            raw = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) // 4 for r in raw], pa.int64()),
                    pa.array([sha(r).hexdigest() for r in raw], pa.string()),
                    pa.array([sha(bpe.decode(r)).hexdigest() for r in raw], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the encoded and decoded texts of all documents."""
    return digests(table(spark, sf_dir, "documents"))
