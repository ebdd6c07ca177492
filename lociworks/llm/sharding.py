"""Resharding by minimum-cost flow (operator 11).

A table lies in files, which belong to old shards. New shards have capacities
in bytes; a byte that stays costs nothing, a byte that changes shards costs
one. A minimum-cost flow from old sizes to new capacities says how many bytes
each shard gives each other one; no way to fill the capacities moves fewer.

Transfers are then made of blocks. Whole files are taken while they fit, the
largest first; of what is left, fewer than one file for each pair of shards is cut into at most
``BLOCKS`` blocks of consecutive rows, which fill the rest in the same way, so shards differ by
less than a block. Files whose rows stay are left where they are; the others
are affected, and their rows are written anew under the new shards. A manifest
says which file or folder holds what and from which slot on.

The law is ``bytes``: shards hold equal numbers of bytes, as nearly as blocks
allow. A row's size is the UTF-8 length of its text (0 if null) and 1 for its
end, so empty rows count too. Slots number a shard's rows from 0, whole files
first, each in its own order; they are worked out from the numbers of rows of files and
blocks, so no row is ranked or shuffled. Groups of equal texts, rows of one id or source, and null ids weigh
nothing here: blocks are places in files, which no value can crowd.

The driver holds a row a file, as Spark's own listing does, and a row a block of the
files that are cut. Repeated rows are rows of their own. An empty table has no
rows in any shard. Extra columns are carried along, whatever they are called. A
table that isn't read from files is written to the shared folder first. The old
shard of a file follows from its name, so the same files give the same result
from any folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.checkpoint import own_path
from .common import table, written

#: New shards, and into how many blocks a file is cut at most.
SHARDS, BLOCKS = 8, 4096
#: Bytes up to which a plan's rows are broadcast; a longer plan is joined by a shuffle.
SENT_BYTES = 64 << 20


def flow(supply: list[int], room: list[int], cost: Callable[[int, int], int]) -> list[list[int]]:
    """How much each supply sends to each room at least total cost: successive shortest paths over what is left."""
    if sum(supply) > sum(room):
        raise ValueError("there is less room than there are bytes")
    n, m = len(supply), len(room)
    sent = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    while any(left):
        # Bellman-Ford from all supplies that are left; places 0 to n-1 are supplies, the others rooms
        far = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if far[i] + cost(i, j) < far[n + j]:
                        far[n + j], came[n + j], changed = far[i] + cost(i, j), i, True
                    if sent[i][j] and far[n + j] - cost(i, j) < far[i]:
                        far[i], came[i], changed = far[n + j] - cost(i, j), n + j, True
        at = min((n + j for j in range(m) if free[j]), key=lambda x: (far[x], x))
        path = [at]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        back = [sent[b][a - n] for a, b in zip(path, path[1:], strict=False) if a >= n]
        amount = min([left[path[0]], free[at - n], *back])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                sent[a][b - n] += amount
            else:
                sent[b][a - n] -= amount
        left[path[0]] -= amount
        free[at - n] -= amount
    return sent


def even_rooms(total: int, n: int) -> list[int]:
    return [total // n + (j < total % n) for j in range(n)]


def old_shard(path: str, n: int) -> int:
    """The shard that a file belongs to: by its name, so from any folder the same."""
    return zlib.crc32(path.rpartition("/")[2].encode()) % n


@dataclass(frozen=True)
class Piece:
    """A file, or a block of one: where it was and where it goes."""

    path: str
    block: int | None
    old: int
    n_rows: int
    size: int
    shard: int = -1
    slot: int = 0


@dataclass(frozen=True)
class Plan:
    n_shards: int
    #: Bytes from each old shard to each new one, as the flow has it.
    sent: list[list[int]]
    #: Whole files, and blocks of files that are cut, in the order of their slots.
    pieces: list[Piece]
    #: Rows of a block, by file that is cut.
    cut: dict[str, int]

    @property
    def affected(self) -> list[str]:
        """Files any of whose rows change shards."""
        return sorted({p.path for p in self.pieces if p.old != p.shard} | set(self.cut))

    def sizes(self) -> list[int]:
        out = [0] * self.n_shards
        for p in self.pieces:
            out[p.shard] += p.size
        return out


def fill(pieces: list[Piece], need: dict[int, int]) -> tuple[list[Piece], list[Piece]]:
    """Pieces of one old shard put where they fit, the largest first and rather where they are; and those that fit nowhere. need is what each shard still lacks, and is brought up to date."""
    put, unfit = [], []
    for p in sorted(pieces, key=lambda p: (-p.size, p.path, p.block or 0)):
        fits = [j for j, room in need.items() if p.size <= room]
        if not fits:
            unfit.append(p)
            continue
        to = p.old if p.old in fits else max(fits, key=lambda j: (need[j], -j))
        need[to] -= p.size
        put.append(Piece(p.path, p.block, p.old, p.n_rows, p.size, to))
    return put, unfit


def _rows(docs: DataFrame) -> DataFrame:
    """Place and size of each row; the row itself is one column, so no name clashes."""
    meta = docs.metadataColumn("_metadata")
    size = F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("long") + 1
    return docs.select(meta["file_path"].alias("path"), meta["row_index"].alias("at"), size.alias("size"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def stored(docs: DataFrame) -> DataFrame:
    """docs as a table in files: itself, or written down where it isn't read from any."""
    return docs if docs.inputFiles() else written(docs)


def plan(docs: DataFrame, n_shards: int = SHARDS, rooms: list[int] | None = None, old: Callable[[str, int], int] = old_shard, blocks: int = BLOCKS) -> Plan:
    """Where the rows of a stored table go. rooms: bytes of each new shard; equal ones by default."""
    places = written(_rows(docs).select("path", "at", "size"))  # narrow, so that texts are read once
    of_file = places.groupBy("path").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row a file
    files = [Piece(r["path"], None, old(r["path"], n_shards), r["n"], r["size"]) for r in of_file]
    supply = [0] * max([n_shards, *(f.old + 1 for f in files)])
    for f in files:
        supply[f.old] += f.size
    sent = flow(supply, rooms or even_rooms(sum(supply), n_shards), lambda i, j: int(i != j))
    need = [dict(enumerate(row)) for row in sent]
    pieces, whole_unfit = [], []
    for i in range(len(supply)):
        put, unfit = fill([f for f in files if f.old == i], need[i])
        pieces += put
        whole_unfit += unfit
    cut = {f.path: -(-f.n_rows // blocks) for f in whole_unfit}
    if cut:
        spark = docs.sparkSession
        every = _sent(spark, pa.table({"path": list(cut), "every": pa.array(list(cut.values()), pa.int64())}))
        own = places.where(F.col("path").isin(*cut)).join(every, "path").groupBy("path", F.expr("at div every").alias("block"))
        of_block = own.agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # at most BLOCKS a file that is cut
        home = {f.path: f.old for f in whole_unfit}
        parts = [Piece(r["path"], r["block"], home[r["path"]], r["n"], r["size"]) for r in of_block]
        for i in range(len(supply)):
            put, unfit = fill([p for p in parts if p.old == i], need[i])
            pieces += put
            for p in unfit:  # what no rest can take whole goes where most is lacking
                lacking = [sum(row[j] for row in need) for j in range(n_shards)]
                to = max(range(n_shards), key=lambda j: (lacking[j], j == p.old, -j))
                need[i][to] -= p.size
                pieces.append(Piece(p.path, p.block, p.old, p.n_rows, p.size, to))
    slots, numbered = [0] * n_shards, []
    for p in sorted(pieces, key=lambda p: (p.block is not None, p.path, p.block or 0)):
        numbered.append(Piece(p.path, p.block, p.old, p.n_rows, p.size, p.shard, slots[p.shard]))
        slots[p.shard] += p.n_rows
    return Plan(n_shards, sent, numbered, cut)


def _sent(spark: SparkSession, rows: pa.Table) -> DataFrame:
    df = spark.createDataFrame(rows)
    return F.broadcast(df) if rows.nbytes <= SENT_BYTES else df


def place(rows: DataFrame, made: Plan) -> DataFrame:
    """rows (path, at, and others) with shard and slot."""
    spark = rows.sparkSession
    whole = [p for p in made.pieces if p.block is None]
    parts = [p for p in made.pieces if p.block is not None]

    def columns(pieces: list[Piece], **more) -> pa.Table:
        return pa.table({"path": pa.array([p.path for p in pieces], pa.string()), **more, "shard": pa.array([p.shard for p in pieces], pa.int32()), "slot": pa.array([p.slot for p in pieces], pa.int64())})

    in_whole = rows.join(_sent(spark, columns(whole).rename_columns(["path", "shard", "first"])), "path")
    out = in_whole.select(*rows.columns, "shard", (F.col("first") + F.col("at")).alias("slot"))
    if parts:
        every = pa.array([made.cut[p.path] for p in parts], pa.int64())
        block = pa.array([p.block for p in parts], pa.int64())
        cut = columns(parts, every=every, block=block).rename_columns(["path", "every", "block", "shard", "first"])
        steps = _sent(spark, pa.table({"path": list(made.cut), "every": pa.array(list(made.cut.values()), pa.int64())}))
        numbered = rows.where(F.col("path").isin(*made.cut)).join(steps, "path").withColumn("block", F.expr("at div every"))
        met = numbered.join(_sent(spark, cut.drop_columns(["every"])), ["path", "block"])
        out = out.unionByName(met.select(*rows.columns, "shard", (F.col("first") + F.col("at") - F.col("block") * F.col("every")).alias("slot")))
    return out


@dataclass(frozen=True)
class Layout:
    """A table in its new shards: files that were left, and a folder with the rows of the others."""

    plan: Plan
    docs: DataFrame
    folder: str | None

    def rows(self) -> DataFrame:
        """(row, shard, slot) of the whole table, read from where it now lies."""
        kept = place(_rows(self.docs).where(~F.col("path").isin(*self.plan.affected)) if self.folder else _rows(self.docs), self.plan)
        kept = kept.select("row", "shard", "slot")
        if not self.folder:
            return kept
        spark = self.docs.sparkSession
        moved = spark.read.schema(kept.schema).parquet(self.folder)
        return kept.unionByName(moved.select("row", F.col("shard").cast("int").alias("shard"), "slot"))

    def manifest(self) -> DataFrame:
        """(shard, path, first_slot, n_rows): each file that stays and, for each shard, the folder with what was written anew."""
        left = [(p.shard, p.path, p.slot, p.n_rows) for p in self.plan.pieces if p.path not in set(self.plan.affected)]
        for j in range(self.plan.n_shards):
            own = [p for p in self.plan.pieces if p.shard == j and p.path in set(self.plan.affected)]
            if own:
                left.append((j, f"{self.folder}/shard={j}", min(p.slot for p in own), sum(p.n_rows for p in own)))
        return self.docs.sparkSession.createDataFrame(left, "shard int, path string, first_slot long, n_rows long")


def rewrite(docs: DataFrame, made: Plan, folder: str | None = None) -> Layout:
    """Writes the rows of affected files under their new shards; all other files stay as they are, and so do the old ones, until nobody reads them."""
    if not made.affected:
        return Layout(made, docs, None)
    folder = folder or own_path(docs.sparkSession, "shards")
    moved = place(_rows(docs).where(F.col("path").isin(*made.affected)), made)
    moved.select("row", "slot", "shard").write.partitionBy("shard").parquet(folder)
    return Layout(made, docs, folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes, read from where resharding has put them."""
    docs = stored(table(spark, sf_dir, "documents"))
    rows = rewrite(docs, plan(docs)).rows()
    text = F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))
    return rows.select(
        F.col("row")["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
