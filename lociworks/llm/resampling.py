"""Importance resampling towards a target distribution (operator 13).

Features are all runs of 1 to ``n`` consecutive words, hashed by CRC-32 into
buckets. A bucket's gain says how much likelier it is in the target than in the
documents; a document's weight is the floored mean of its features' gains. A
fixed Gumbel variate for each id makes the highest scores a draw without
replacement, in proportion to exp(weight / 1000).

The vocabulary has a head and a tail. A first pass finds frequent words and
pairs: each task keeps counters that are cut back when they grow too many, so
one task sends a bounded number, and every feature that makes up more than
1 / HEAD of a task's features is among them. The CRC states of the words and
the buckets of the pairs are worked out once and broadcast. A feature outside
the head takes its CRC directly, pairs from the state of their first word. Both
give the same buckets, so the head changes the speed alone, and bucket totals
are exact for any head.

Long texts are cut into pieces between words. The draw counts documents by
score, which takes one of some ten thousand values, and ranks only those that reach the
score where the draw ends; ranks are dealt by range, so no task ranks them all.

A null text has no words, so no features and weight 0. A null id draws its variate
from the empty text and is the smallest in ties. Repeated rows are documents of their own
and have ranks of their own. An empty table gives no rows; an empty target has
no features (all gains follow from the formula with T = 0). Extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import placed
from .common import table, text_slices, written

#: Buckets that features are hashed into.
BUCKETS = 10_000
#: Most words of a feature.
N = 1
#: Words, and as many pairs, that the head holds at most; none is longer than HEAD_BYTES, which bounds what is broadcast.
HEAD, HEAD_BYTES = 1 << 16, 64
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Part of the variates' text; documents with fewer words are never drawn; percent of the others that are drawn.
SEED, LEAST_WORDS, PERCENT = 2024, 20, 10

#: Lower-cases A-Z and makes a space of every byte that is in no word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def pieces(text: bytes | None, n: int = N) -> Iterator[list[bytes]]:
    """The words of a text, PIECE bytes at a time; each list but the first begins with the n - 1 words before it."""
    folded, start, before = (text or b"").translate(_FOLD), 0, []
    while start < len(folded):
        end = len(folded) if len(folded) - start <= PIECE else folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        found = before + folded[start:end].split()
        yield found
        start, before = end, found[len(found) - n + 1 :] if n > 1 else []


class Vocabulary:
    """Buckets of features: frequent ones looked up, the others by CRC."""

    def __init__(self, words: Iterable[bytes] = (), pairs: Iterable[tuple[bytes, bytes]] = (), n: int = N, buckets: int = BUCKETS):
        self.n, self.buckets = n, buckets
        self.states = {w: zlib.crc32(w) for w in words}
        self.of_word = {w: s % buckets for w, s in self.states.items()}
        self.of_pair = {(a, b): zlib.crc32(b" " + b, self._state(a)) % buckets for a, b in pairs}

    def _state(self, word: bytes) -> int:
        state = self.states.get(word)
        return zlib.crc32(word) if state is None else state

    def of(self, words: list[bytes], begun: int = 0) -> list[int]:
        """The buckets of all features that end at place ``begun`` or later."""
        head, m = self.of_word, self.buckets
        out = [head[w] if w in head else zlib.crc32(w) % m for w in (words[begun:] if begun else words)]
        for k in range(2, self.n + 1):
            for i in range(max(0, begun - k + 1), len(words) - k + 1):
                known = self.of_pair.get((words[i], words[i + 1])) if k == 2 else None
                out.append(zlib.crc32(b" " + b" ".join(words[i + 1 : i + k]), self._state(words[i])) % m if known is None else known)
        return out

    def features(self, text: bytes | None) -> Iterator[list[int]]:
        for i, words in enumerate(pieces(text, self.n)):
            yield self.of(words, min(self.n - 1, len(words)) if i else 0)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def cut_back(counts: Counter, most: int) -> None:
    """Leaves at most ``most`` counters: what the next one counts is taken from all, which no feature above that share loses by."""
    if len(counts) > most:
        values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        less = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
        for key in [k for k, v in counts.items() if v <= less]:
            del counts[key]
        for key in counts:
            counts[key] -= less


def frequent(docs: DataFrame, n: int = N, head: int = HEAD) -> list[tuple[bytes, ...]]:
    """Up to ``head`` frequent words, and as many frequent pairs where n is 2 or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, ...] = (Counter(), Counter())
        for batch in text_slices(batches):
            for text in _texts(batch):
                for words in pieces(text, min(n, 2)):
                    found[0].update(words)
                    if n > 1:
                        found[1].update(zip(words, words[1:], strict=False))
                for c in found:
                    if len(c) > 4 * head:
                        cut_back(c, head)
        for size, c in enumerate(found, 1):
            cut_back(c, head)
            rows = [(k, v) for k, v in ((key if size == 2 else (key,), v) for key, v in c.items()) if all(len(w) <= HEAD_BYTES for w in k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k, _ in rows], pa.binary()), pa.array([size] * len(rows), pa.int32()), pa.array([v for _, v in rows], pa.int64())], names=["feature", "size", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "feature binary, size int, n long").groupBy("size", "feature").agg(F.sum("n").alias("n"))
    out = []
    for size in range(1, min(n, 2) + 1):
        top = counted.where(F.col("size") == size).orderBy(F.desc("n"), "feature").limit(head)
        out += [tuple(bytes(r[0]).split(b" ")) for r in top.select("feature").collect()]
    return out


def vocabulary(docs: DataFrame, n: int = N, buckets: int = BUCKETS, head: int = HEAD) -> Vocabulary:
    found = frequent(docs, n, head)
    return Vocabulary((f[0] for f in found if len(f) == 1), (f for f in found if len(f) == 2), n, buckets)


def bucket_totals(docs: DataFrame, shared) -> dict[int, int]:
    """How many features of all texts each bucket has; one row a bucket and task is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total = np.zeros(known.buckets, dtype=np.int64)
        for batch in text_slices(batches):
            for text in _texts(batch):
                for ids in known.features(text):
                    total += np.bincount(np.array(ids, dtype=np.int64), minlength=known.buckets)[: known.buckets]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["bucket", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in found.collect()}  # one row a bucket


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of how much likelier each bucket is in the target), smoothed by one feature a bucket."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = lambda b: float(target.get(b, 0) + 1) * float(s_all + buckets) / (float(source.get(b, 0) + 1) * float(t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def weigh(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, head: int = HEAD) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary(docs, n, buckets, head))
    gain = gains(bucket_totals(docs, shared), bucket_totals(target, shared), buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in text_slices(batches):
            n_words, n_features, weight = [], [], []
            for text in _texts(batch):
                total, count, longest = 0, 0, 0
                for i, words in enumerate(pieces(text, known.n)):
                    begun = min(known.n - 1, len(words)) if i else 0
                    ids = known.of(words, begun)
                    total, count, longest = total + int(gain[ids].sum()) if ids else total, count + len(ids), longest + len(words) - begun
                n_words.append(longest)
                n_features.append(count)
                weight.append(total // count if count else 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_features, weight))], names=["doc_id", "n_words", "n_features", "weight"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def variate(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate of an id, floored in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """weighed with score and rank: the highest scores of percent of the documents with enough words, from 1 on; null for the others."""
    scored = written(weighed.withColumn("score", F.col("weight") + variate(F.col("doc_id"), seed)))
    able = F.col("n_words") >= least_words
    counts = sorted(((r.score, r.n) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # a row a score
    n_drawn, cut, above = percent * sum(n for _, n in counts) // 100, None, 0
    for score, n in counts:
        if above >= n_drawn:
            break
        cut, above = score, above + n
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reach = able & (F.col("score") >= cut)
    order = scored.where(reach).withColumn("_down", -F.col("score")).withColumn("_row", F.monotonically_increasing_id())
    rank = F.col("_before") + 1
    ranked = placed(order, ["_down", "doc_id", "n_features", "weight", "_row"]).select(*scored.columns, F.when(rank <= n_drawn, rank).cast("long").alias("rank"))
    return scored.where(~reach).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark, its score and its rank in the draw."""
    weighed = weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of a text's UTF-8 bytes in DuckDB's SQL; its 256 entries follow from the polynomial. {0} is the text, ``crc_table`` a one-row table in reach.
CRC_TABLE_SQL = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"


def crc_sql(text: str) -> str:
    """DuckDB's SQL for the CRC-32 of a text that isn't empty; crc_table's column crc must be in reach."""
    codes = f"list_transform(range(octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)])), 4294967295)"


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH {CRC_TABLE_SQL},
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS_SQL} AS words FROM documents),
goal AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
counted AS (SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM docs) GROUP BY word),
wanted AS (SELECT word, count(*) AS n FROM goal GROUP BY word),
hashed AS (SELECT word, {crc_sql("word")} % 10000 AS bucket FROM (SELECT word FROM counted UNION SELECT word FROM wanted), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM hashed JOIN counted USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM hashed JOIN wanted USING (word) GROUP BY bucket),
sums AS (SELECT CAST(coalesce((SELECT sum(s) FROM s), 0) AS DOUBLE) AS all_s, CAST(coalesce((SELECT sum(t) FROM t), 0) AS DOUBLE) AS all_t),
gained AS (
  SELECT bucket, floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (all_s + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (all_t + 10000)))) AS gain
  FROM s FULL JOIN t USING (bucket), sums
), of_word AS (SELECT word, gain FROM hashed JOIN gained USING (bucket)),
of_doc AS (SELECT row, floor(sum(gain) / count(*)) AS weight FROM (SELECT row, unnest(words) AS word FROM docs) JOIN of_word USING (word) GROUP BY row),
scored AS (
  SELECT row, doc_id, len(words) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM docs LEFT JOIN of_doc USING (row)
), ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""
