"""SimHash near-duplicates with pigeonring filtering (operator 9).

Fingerprints. Texts are lower-cased (A-Z), cut into words at white space and
into shingles of SHINGLE words, repeats included; a text of fewer words is one
shingle, one without words has fingerprint zero. A bit is set if it is set in
more than half of the shingles' XXH64 hashes.

Candidates. The 64 bits form a ring of RING segments. If two fingerprints
differ in at most LIMIT bits then, by the pigeonring principle, there is a
segment from which every chain of l consecutive segments differs in at most
l * LIMIT / RING bits. With 8 segments and a limit of 4 the chains of 1, 3, 5
and 7 may differ in 0, 1, 2 and 3 bits, so they hold at least 1, 2, 3 and 4
segments that are equal. The places of the first four equal ones, counted from
the start, are one of 14 choices; over all starts these are 70 sets of four
segments. Each set is a key of 32 bits. Fingerprints that share a key are
candidates; a pair must pass all chains from one of the starts that the key's
set stands for before the full Hamming check.

Skew. Exact copies are one fingerprint from the start. Keys that more than
BLOCK fingerprints share are cut into blocks, and pairs of blocks are compared in
tasks of their own. A task returns no more than a spanning forest of the links
it finds, so no group's pairs are all emitted. Every link between different
fingerprints either is returned or joins two that are joined already.

Components come from alternating large-star and small-star steps over the
links, written to the checkpoint folder after each step. Only counts reach the
driver. What is joined to the members of a component is one row a component; it
is broadcast up to BROADCAST_ROWS rows, and beyond that written down first, so
that the join has nothing but shuffles below it and a large component's
partition can be split. All other joins are told to shuffle: Spark sizes a table
of keys as if exploding made no rows, and would send it through the driver.

Null texts count as empty. Repeated rows give repeated results. An empty table
gives an empty result. Null ids are kept and never name a component unless all
ids of one are null. Ids, null or repeated, don't say which documents are the
same: keep_one() keeps one row of each component. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_LOWER, checkpointed, shuffled, table, text_slices, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE, LIMIT, RING, SEED = 4, 4, 8, 42
#: Bytes of text that a task cuts at a time.
SLICE = 2 << 20
#: Fingerprints of one key that are compared in one task.
BLOCK = 1024
_SEGMENT = 64 // RING
#: Rows of two integers up to which a side of a join is broadcast, some 10 MB as a hash table.
BROADCAST_ROWS = 100_000


def _key_sets() -> dict[tuple[int, ...], list[int]]:
    """The sets of four segments that keys hold, and the starts of the chains that each stands for."""
    out: dict[tuple[int, ...], list[int]] = {}
    for start in range(RING):
        for places in combinations(range(RING - 1), 4):
            if all(place <= 2 * k for k, place in enumerate(places)):
                out.setdefault(tuple(sorted((start + p) % RING for p in places)), []).append(start)
    return dict(sorted(out.items()))


KEY_SETS = _key_sets()
_STARTS = list(KEY_SETS.values())


def fingerprint(text: str) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.translate(ASCII_LOWER))]
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = [0, *ends[: len(words) - SHINGLE].tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
    n = len(hashes)
    columns = np.array(hashes, dtype=np.uint64).view(np.uint8).reshape(n, 8)
    # each byte column is counted by value: 256 counts, then 8 sums
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp, more): fp is the fingerprint as a signed 64-bit integer, more are further columns of integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, SLICE):
            fps = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], ["doc_id", "fp", *more])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return own.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, _SEGMENT * (i % RING)).bitwiseAND(F.lit((1 << _SEGMENT) - 1))


def keys(fp: Column) -> Column:
    """The candidate keys of a fingerprint: the number of a set of segments, and these segments, packed in one integer each."""
    out = []
    for number, segments in enumerate(KEY_SETS):
        packed = F.lit(number).cast("long")
        for i in segments:
            packed = F.shiftleft(packed, _SEGMENT) + _segment(fp, i)
        out.append(packed)
    return F.array(*out)


def chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """For each chain from a start, longest first: the bits it holds and how many of them may differ."""
    out, mask = [], 0
    for n in range(1, RING + 1):
        mask |= ((1 << _SEGMENT) - 1) << (_SEGMENT * ((start + n - 1) % RING))
        out.append((np.uint64(mask), n * LIMIT // RING))
    return out[::-1]


def links(a: np.ndarray, b: np.ndarray, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints that pass every chain from one of the starts, the last of which is the full Hamming check."""
    differ = a[:, None] ^ b[None, :]
    passed = np.zeros(differ.shape, dtype=bool)
    for start in starts:
        full, *chains = chain_masks(start)
        i, j = np.nonzero(np.bitwise_count(differ & chains[0][0]) <= chains[0][1])
        left = differ[i, j]
        for mask, budget in (*chains[1:], full):
            ok = np.bitwise_count(left & mask) <= budget
            i, j, left = i[ok], j[ok], left[ok]
        passed[i, j] = True
    return np.nonzero(passed)


def forest(members: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (i, j) that join what no earlier one has joined."""
    parent = list(range(len(members)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, fps, others): links within fps, or between fps and others."""
    for batch in batches:
        left, right = [], []
        for key, fps, others in zip(*(c.to_pylist() for c in batch.columns)):
            starts = _STARTS[key >> (4 * _SEGMENT)]
            a = np.array(fps, dtype=np.int64)
            b = a if others is None else np.array(others, dtype=np.int64)
            both = a if others is None else np.concatenate([a, b])
            found_i, found_j = [], []
            for at in range(0, len(a), 512):
                i, j = links(a[at : at + 512].view(np.uint64), b.view(np.uint64), starts)
                i = i + at
                ok = i < j if others is None else np.ones(len(i), dtype=bool)
                found_i.append(i[ok])
                found_j.append(j[ok] + (0 if others is None else len(a)))
            for x, y in forest(both, np.concatenate(found_i), np.concatenate(found_j)):
                left.append(int(both[x]))
                right.append(int(both[y]))
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def candidate_links(distinct: DataFrame) -> DataFrame:
    """(a, b): for distinct fingerprints, links that join all that LIMIT or fewer differing bits join."""
    # each fingerprint becomes many rows, so a few small partitions of them are dealt out first
    dealt = distinct.select("fp").repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keyed = dealt.select("fp", F.explode(keys(F.col("fp"))).alias("key"))
    # fingerprints of a key in blocks: a block's share is set by the hash of the fingerprint and the size of the key
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(shuffled(sizes), "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    member = shared.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # one block: the key is compared in one row; more: a row for each pair of blocks
    small = member.where("blocks = 1").groupBy("key").agg(F.collect_list("fp").alias("fps")).select(
        "key",
        "fps",
        F.lit(None).cast("array<bigint>").alias("others"),
    )
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("lo"), F.greatest("block", k).alias("hi")))
    spread = member.where("blocks > 1").select("key", "fp", "block", F.explode(pairs).alias("p")).select("key", "p.lo", "p.hi", "fp", "block")
    met = spread.repartition("key", "lo", "hi").groupBy("key", "lo", "hi").agg(
        F.collect_list(F.when(F.col("block") == F.col("lo"), F.col("fp"))).alias("fps"),
        F.collect_list(F.when(F.col("block") != F.col("lo"), F.col("fp"))).alias("rest"),
    )
    large = met.select("key", "fps", F.when(F.col("lo") != F.col("hi"), F.col("rest")).alias("others"))
    return small.unionAll(large).mapInArrow(_compare, "a long, b long").distinct()


def beside(rows: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """rows joined to a table of one row a key, which many rows may share."""
    one = checkpointed(one)
    return rows.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else shuffled(one), key)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for the nodes of edges (a, b)."""
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        # large star: neighbours above a node join its least neighbour
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = checkpointed(beside(both, least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct())
        # small star: a node and its lesser neighbours join the least of them
        small = beside(large, large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        edges = checkpointed(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(
        F.col("a").alias("node"),
        F.col("b").alias("root"),
    ).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def rooted(distinct: DataFrame) -> DataFrame:
    """distinct with root, the least fingerprint of each one's component. distinct: checkpointed, one row a fingerprint fp."""
    roots = connected_components(candidate_links(distinct.select("fp")))
    return distinct.join(shuffled(roots), distinct["fp"] == roots["node"], "left").select(
        *[distinct[c] for c in distinct.columns],
        F.coalesce("root", "fp").alias("root"),
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every document row."""
    own = checkpointed(fingerprints(docs))
    distinct = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = checkpointed(connected_components(candidate_links(distinct.select("fp"))))
    # only fingerprints with a link are joined by component; any other is a component of its own
    linked = roots.join(shuffled(distinct), roots["node"] == distinct["fp"]).select("fp", "root", "least")
    named = beside(
        linked.select("fp", "root"),
        linked.groupBy("root").agg(F.min("least").alias("named")),
        "root",
    ).select("fp", "named", F.lit(True).alias("linked"))
    groups = distinct.join(shuffled(named), "fp", "left").select("fp", F.when(F.col("linked"), F.col("named")).otherwise(F.col("least")).alias("component_id"))
    return beside(own, groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the one of the least doc_id, null last; of rows that share it, the one whose columns have the least hash.

    Rows get a key of their own, written down before anything is chosen by it. So null and repeated ids neither join
    components nor keep more than one row of any.
    """
    columns = docs.columns
    keyed = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.monotonically_increasing_id().alias("key")))
    own = keyed.select("row.doc_id", "row.text", F.xxhash64(F.col("row").cast("string")).alias("digest"), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "key")).alias("first")
    # exact copies meet by fingerprint first, in part before the shuffle
    each = fingerprints(own, "digest", "key").groupBy("fp").agg(first)
    chosen = rooted(checkpointed(each)).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    return keyed.join(shuffled(chosen), "key", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
