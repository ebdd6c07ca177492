"""An exact neighbour index: balls about landmarks, pruned by the triangle inequality.

Landmarks are rows taken by a hash of their ids, some four times the square root of all, at most ``MOST``. Each row
belongs to the ball of its nearest landmark, which knows how many rows it has and how near and far the nearest and
furthest are. A query's k-th neighbour is no further than its k-th nearest landmark, and no further than the far sides of balls
that hold k rows together; a ball is met only if a row in it can be that near. Balls near each other share a cell, larger
ones are cut, and a cell's queries are cut into waves. A task holds one cell and one wave, at most ``CELL`` rows
and ``WAVE`` queries, however many rows are alike; fewer where that still gives work to all. Within a cell a product of
matrices says which rows may be near enough, with a bound on its error; those alone are compared by exact differences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed

#: Landmarks at most; together they are broadcast.
MOST = 4096
#: Rows of a cell, and queries of a wave, at most; below FEW neither is cut for the sake of more tasks.
CELL, WAVE, FEW = 65536, 32768, 1024
#: Tasks of a search that are wanted where there are few rows and queries.
SPREAD = 64
#: Landmarks by which balls are put in order.
HUBS = 16
#: Digits that distances are rounded to before they are compared; ties go to the lower id.
DIGITS = 6
#: Numbers that a task holds of a block of differences or distances.
CHUNK = 1 << 21
#: Rows that a task sends on at a time.
SENT = 8192


def as_vectors(df: DataFrame, id_col: str, vector: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 1)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all of b, from differences, a part at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, CHUNK // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(2))
    return out


def squares(a: np.ndarray, b: np.ndarray, side: int) -> np.ndarray:
    """Squares of the distances of all rows of a to all of b by a product of matrices, surely not over (side -1) or under (side 1) the true ones."""
    off = 1 + side * 4 * (a.shape[1] + 8) * np.finfo(np.float64).eps
    out = a @ b.T
    out *= -2
    out += off * (a * a).sum(1)[:, None]
    out += off * (b * b).sum(1)[None]
    return out


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all rows of a to all of b, from below and from above."""
    return np.sqrt(np.maximum(squares(a, b, -1), 0)), np.sqrt(np.maximum(squares(a, b, 1), 0))


def reached(far: np.ndarray) -> np.ndarray:
    """The square of what a true distance can be at most if rounded it is no more than far."""
    return (far * (1 + 1e-12) + 10.0**-DIGITS) ** 2


def pairs_apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded distances of the rows i of a to the rows j of b, from differences."""
    out, step = np.empty(len(i)), max(1, CHUNK // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        out[at : at + step] = np.sqrt(((a[i[at : at + step]] - b[j[at : at + step]]) ** 2).sum(1))
    return np.round(out, DIGITS)


@dataclass(frozen=True)
class Cells:
    """How balls lie in cells: the first cell of each ball and into how many it is cut, and the balls of each cell."""

    first: np.ndarray
    parts: np.ndarray
    #: A place for each ball in each of its cells, and where each cell begins among them.
    ball: np.ndarray
    begin: np.ndarray

    def met(self, balls: np.ndarray) -> np.ndarray:
        """Which cells hold a ball that is met, a row a query."""
        return np.logical_or.reduceat(balls[:, self.ball], self.begin, axis=1)


@dataclass(frozen=True)
class Landmarks:
    """What is broadcast: landmarks' ids and vectors, and of each ball its rows, least and greatest distance."""

    ids: np.ndarray
    v: np.ndarray
    n: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def cells(self, rows: int) -> Cells:
        """Cells of at most so many rows, about: balls near each other together, larger ones cut."""
        first, parts, ball, begin, held = np.zeros(len(self.n), np.int64), np.ones(len(self.n), np.int64), [], [], 0
        hub = bounds(self.v, self.v[:HUBS])[0].argmin(1) if len(self.v) else []
        for b in np.argsort(hub, kind="stable"):
            if not self.n[b]:
                continue
            parts[b] = -(-self.n[b] // rows)
            if not begin or held + self.n[b] > rows:
                first[b], held = len(begin), 0
                for _ in range(parts[b]):
                    begin.append(len(ball))
                    ball.append(b)
            else:
                first[b] = len(begin) - 1
                ball.append(b)
            held += self.n[b]
        return Cells(first, parts, np.array(ball, np.int64), np.array(begin, np.int64))

    def blocks(self, n: int, cells: int = 1) -> Iterator[slice]:
        """Parts of n queries that are looked at together."""
        step = max(1, min(256, CHUNK // max(1, len(self.ids)), SENT // max(1, cells)))
        return (slice(i, i + step) for i in range(0, n, step))

    def balls_of(self, q: np.ndarray, v: np.ndarray, k: int, itself: bool) -> tuple[np.ndarray, np.ndarray]:
        """(the balls that can hold one of a query's k nearest rows, how far those are at most), a row a query."""
        slack = 10.0**-DIGITS
        low, high = bounds(v, self.v)
        own = high if itself else np.where(self.ids[None] == q[:, None], np.inf, high)
        most = np.partition(own, k - 1, axis=1)[:, k - 1] if own.shape[1] >= k else np.full(len(q), np.inf)
        reach = np.where(self.n > 0, high + self.far, np.inf)
        order = np.argsort(reach, axis=1, kind="stable")
        enough = np.cumsum(self.n[order], axis=1) >= k + (not itself)
        sides = np.take_along_axis(reach, order, 1)[np.arange(len(q)), enough.argmax(1)]
        most = np.where(enough.any(1), np.minimum(most, sides), most)
        least = np.maximum(0.0, np.maximum(low - self.far, self.near - high))
        return (least <= most[:, None] + slack) & (self.n > 0), most

    def between(self, v: np.ndarray, far: list[np.ndarray], cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (cells that rows of about the given distances may lie in, for each distance how many rows other cells have nearer).

        Balls about the query itself are among those to meet, so its own row is never counted unseen.
        """
        slack = 10.0**-DIGITS
        for low, high, at in zip(*bounds(v, self.v), far, strict=True):
            least, most = np.maximum(0.0, np.maximum(low - self.far, self.near - high)), high + self.far
            within = most[:, None] < at[None] - slack
            meets = (((least[:, None] <= at[None] + slack) & ~within).any(1) | (least <= slack)) & (self.n > 0)
            met, seen = cells.met(meets[None])[0], np.zeros(len(self.n), dtype=bool)
            # whoever meets a cell meets all of its balls, and all cells of a ball that is cut
            seen[cells.ball[np.repeat(met, np.diff([*cells.begin, len(cells.ball)]))]] = True
            yield np.flatnonzero(met), (self.n[:, None] * (within & ~seen[:, None])).sum(0)


@dataclass(frozen=True)
class Index:
    #: (id, v, ball) of all rows, written down.
    rows: DataFrame
    marks: Landmarks


def build(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST) -> Index:
    """The index of all rows that have a vector."""
    own = as_vectors(rows, id_col, vector, "id")
    n = own.count()
    wanted = min(most, max(16, 4 * math.isqrt(n)))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow()
    ids, v = chosen.column("id").to_numpy(), matrix(chosen.column("v"))
    sent = rows.sparkSession.sparkContext.broadcast(v)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK // MOST):
                part = batch.slice(at, CHUNK // MOST)
                own = matrix(part.column("v"))
                ball = squares(own, sent.value, -1).argmin(1)  # of two that are equally near either will do
                far = np.sqrt(((own - sent.value[ball]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ball, pa.int32()), pa.array(far)], ["id", "v", "ball", "far"])

    dealt = checkpointed(own.mapInArrow(assign, "id long, v array<double>, ball int, far double"))
    count, near, far = np.zeros(len(ids), dtype=np.int64), np.full(len(ids), np.inf), np.zeros(len(ids))
    for r in dealt.groupBy("ball").agg(F.count("*").alias("n"), F.min("far").alias("near"), F.max("far").alias("far")).collect():  # a row a landmark
        count[r.ball], near[r.ball], far[r.ball] = r.n, r.near, r.far
    return Index(dealt.select("id", "v", "ball"), Landmarks(ids, v, count, near, far))


def sizes(queries: int, rows: int) -> tuple[int, int]:
    """(rows of a cell, queries of a wave): as many of both as give SPREAD tasks and send the fewest rows and queries on, within the bounds."""
    waves = max(1, math.ceil(queries / WAVE), round(math.sqrt(SPREAD * queries / max(1, rows))))
    cells = max(math.ceil(rows / CELL), math.ceil(SPREAD / waves), 1)
    return min(CELL, max(FEW, math.ceil(rows / cells))), min(WAVE, max(FEW, math.ceil(queries / waves)))


def in_cells(index: Index, cells: Cells) -> DataFrame:
    """(id, v, ball, cell) of all rows."""
    spark = index.rows.sparkSession
    plan = spark.createDataFrame([(b, *map(int, x)) for b, x in enumerate(zip(cells.first, cells.parts))], "ball int, _first int, _parts int")
    cell = F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts"))
    return index.rows.join(F.broadcast(plan), "ball").select("id", "v", "ball", cell.cast("int").alias("cell"))  # a row a landmark


def routed(queries: DataFrame, index: Index, k: int, itself: bool, cells: Cells) -> DataFrame:
    """(q, v, most, cell) of each query and each cell that it must meet; its neighbours are no further than most. queries: (q, v)."""
    sent = queries.sparkSession.sparkContext.broadcast((index.marks, cells))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, cells = sent.value
        for batch in batches:
            for block in marks.blocks(batch.num_rows if len(cells.begin) else 0, len(cells.begin)):
                part = batch.slice(block.start, block.stop - block.start)
                met, most = marks.balls_of(part.column("q").to_numpy(), matrix(part.column("v")), k, itself)
                at, cell = np.nonzero(cells.met(met))
                taken = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(most[at]), pa.array(cell, pa.int32())], ["q", "v", "most", "cell"])

    return queries.select("q", "v").mapInArrow(route, "q long, v array<double>, most double, cell int")


def in_waves(asked: DataFrame, rows: DataFrame, key: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``wave``: queries of a key are cut into waves, and its rows stand in each of them. Keys that nobody asks for go."""
    waves = checkpointed(asked.groupBy(*key).agg(F.ceil(F.count("*") / size).cast("int").alias("_waves")))
    left = asked.join(waves, key).withColumn("wave", F.pmod(F.xxhash64("q"), F.col("_waves")).cast("int")).drop("_waves")
    right = rows.join(waves, key).withColumn("wave", F.explode(F.sequence(F.lit(0), F.col("_waves") - 1))).drop("_waves")
    return left, right


def by_ball(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, np.ndarray]]]:
    """(ids, vectors, parts) of a cell's rows with their balls together; parts are some thousand rows each, with their balls."""
    order = np.argsort(t.column("ball").to_numpy(), kind="stable")
    ids, v, ball = t.column("id").to_numpy()[order], matrix(t.column("v"))[order], t.column("ball").to_numpy()[order]
    parts, begin = [], 0
    for end in [*(np.flatnonzero(np.diff(ball)) + 1), len(ball)]:
        if end - begin >= FEW or end == len(ball):
            parts += [slice(i, min(i + 2 * FEW, end)) for i in range(begin, end, 2 * FEW)]
            begin = end
    return ids, v, [(p, np.unique(ball[p])) for p in parts]


def nearest(queries: DataFrame, index: Index, k: int, itself: bool = False) -> DataFrame:
    """(q, id, distance, place): the k nearest rows of each query (q, v), place from 1; its own id counts only if itself is true."""
    per, size = sizes(queries.count(), int(index.marks.n.sum()))
    cells = index.marks.cells(per)
    asked, rows = in_waves(checkpointed(routed(queries, index, k, itself, cells)), in_cells(index, cells), ["cell"], size)
    sent = queries.sparkSession.sparkContext.broadcast(index.marks)

    def closest(q: np.ndarray, v: np.ndarray, most: np.ndarray, ids: np.ndarray, rows: np.ndarray, parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, distance) of the k nearest of some rows to each of some queries."""
        marks, at, found, far, most = sent.value, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), most.copy()
        full = np.zeros(len(q), dtype=bool)
        for part, its_balls in parts:
            low, high = bounds(v, marks.v[its_balls])
            least = np.maximum(low - marks.far[its_balls], marks.near[its_balls] - high).min(1)
            asks = np.flatnonzero(least <= most + 10.0**-DIGITS)
            if not len(asks):
                continue
            own, others = v[asks], rows[part]
            limit, d = reached(most[asks]), squares(own, others, -1)
            first = np.flatnonzero(~full[asks])
            if len(first) and len(others) >= k + (not itself):  # the first rows bound what may come
                nth = np.partition(squares(own[first], others, 1), k - itself, axis=1)[:, k - itself]
                limit[first] = np.minimum(limit[first], reached(np.sqrt(nth)))
            i, j = np.nonzero(d <= limit[:, None])
            w, i, new = pairs_apart(own, others, i, j), asks[i], ids[part][j]
            ok = np.isfinite(w) & (itself | (q[i] != new))
            at, found, far = np.concatenate([at, i[ok]]), np.concatenate([found, new[ok]]), np.concatenate([far, w[ok]])
            order = np.lexsort((found, far, at))
            at, found, far = at[order], found[order], far[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            kept = place < k
            at, found, far, last = at[kept], found[kept], far[kept], (place == k - 1)[kept]
            full[at[last]] = True
            most[at[last]] = np.minimum(most[at[last]], far[last])
        return at, found, far

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})]
        if left.num_rows and right.num_rows:
            q, v, most, rows = left.column("q").to_numpy(), matrix(left.column("v")), left.column("most").to_numpy(), by_ball(right)
            for i in range(0, len(q), FEW):
                block = slice(i, i + FEW)
                at, found, far = closest(q[block], v[block], most[block], *rows)
                out.append(pa.table({"q": q[block][at], "id": found, "distance": far}))
        return pa.concat_tables(out)

    key = ["cell", "wave"]
    found = asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInArrow(search, "q long, id long, distance double")
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def met_share(queries: DataFrame, index: Index, k: int, itself: bool = False) -> DataFrame:
    """One row (pairs, met, pruned): all pairs of a query and a row, those in balls that are met, and the share of the others."""
    sent = queries.sparkSession.sparkContext.broadcast(index.marks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for batch in batches:
            for block in marks.blocks(batch.num_rows if len(marks.ids) else 0):
                part = batch.slice(block.start, block.stop - block.start)
                met, _ = marks.balls_of(part.column("q").to_numpy(), matrix(part.column("v")), k, itself)
                yield pa.RecordBatch.from_arrays([pa.array(met @ marks.n)], ["met"])

    all_pairs = queries.count() * int(index.marks.n.sum())
    one = queries.select("q", "v").mapInArrow(count, "met long").agg(F.coalesce(F.sum("met"), F.lit(0)).alias("met"))
    return one.select(F.expr("cast(0 as bigint)").alias("pairs") + all_pairs, "met").toDF("pairs", "met").withColumn("pruned", 1 - F.col("met") / F.col("pairs"))


def ranks(pairs: DataFrame, rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """(q, id, rank): of pairs (q, id) the exact rank of id by distance from q among all other rows, from 1; equal distances by id.

    Balls that are wholly nearer than id count without being met, those wholly further not at all. Rows of the others are
    compared in cells, and the counts are added up.
    """
    index, own = index or build(rows, id_col, vector), as_vectors(rows, id_col, vector, "id")
    gap = F.round(F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)), DIGITS)
    sides = pairs.select("q", "id").distinct().join(own.withColumnRenamed("v", "w"), "id").join(own.select(F.col("id").alias("q"), "v"), "q")
    wanted = sides.withColumn("d", gap).groupBy("q").agg(F.first("v").alias("v"), F.array_sort(F.collect_list(F.struct("d", "id"))).alias("w"))
    asked = wanted.select("q", "v", F.transform("w", lambda x: x["d"]).alias("far"), F.transform("w", lambda x: x["id"]).alias("ids"))
    per, size = sizes(pairs.select("q").distinct().count(), int(index.marks.n.sum()))
    cells = index.marks.cells(per)
    sent = rows.sparkSession.sparkContext.broadcast((index.marks, cells))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each cell that it meets, and once, without a cell, with what it need not meet."""
        marks, cells = sent.value
        for batch in batches:
            for block in marks.blocks(batch.num_rows if len(cells.begin) else 0, len(cells.begin) + 1):
                part, at, cell, nearer = batch.slice(block.start, block.stop - block.start), [], [], []
                far = [np.array(x) for x in part.column("far").to_pylist()]
                for i, (met, n) in enumerate(marks.between(matrix(part.column("v")), far, cells)):
                    at += [i] * (1 + len(met))
                    cell += [-1, *met.tolist()]
                    nearer += [n.tolist(), *[None] * len(met)]
                taken = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell, pa.int32()), pa.array(nearer, pa.list_(pa.int64()))], [*taken.schema.names, "cell", "nearer"])

    routes = checkpointed(asked.mapInArrow(route, "q long, v array<double>, far array<double>, ids array<long>, cell int, nearer array<long>"))
    unmet = routes.where("cell < 0").select("q", F.explode(F.arrays_zip("ids", "nearer")).alias("x")).select("q", F.col("x.ids").alias("id"), F.col("x.nearer").alias("n"))
    left, right = in_waves(routes.where("cell >= 0").drop("nearer"), in_cells(index, cells), ["cell"], size)

    def nearer_than(q: np.ndarray, v: np.ndarray, far: np.ndarray, ids: np.ndarray, other: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How many of some rows stand before each of the wanted ids of some queries; far and ids are a row a query, filled up with -1."""
        low, high, n = squares(v, rows, -1), squares(v, rows, 1), np.zeros(far.shape, np.int64)
        known = np.where(other[None] == q[:, None], np.inf, high)
        low = np.where(other[None] == q[:, None], np.inf, low)
        slack = 10.0**-DIGITS
        for c in range(far.shape[1]):
            w, wanted = far[:, c], far[:, c] >= 0
            sure = known < np.where(w > slack, (w * (1 - 1e-12) - slack).clip(0) ** 2, -1.0)[:, None]
            open_ = (low <= np.where(wanted, reached(w), -np.inf)[:, None]) & ~sure
            i, j = np.nonzero(open_)
            d = pairs_apart(v, rows, i, j)
            before = (d < w[i]) | ((d == w[i]) & (other[j] < ids[i, c]))
            n[:, c] = sure.sum(1) + np.bincount(i[before], minlength=len(q))
        return n

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [pa.table({"q": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})]
        if a.num_rows and b.num_rows:
            q, v, lists = a.column("q").to_numpy(), matrix(a.column("v")), a.column("far").to_pylist()
            other, rows = b.column("id").to_numpy(), matrix(b.column("v"))
            n = np.array([len(x) for x in lists])
            held = np.arange(n.max())[None] < n[:, None]
            far, ids = np.full(held.shape, -1.0), np.full(held.shape, -1, np.int64)
            far[held], ids[held] = np.concatenate(lists), np.concatenate(a.column("ids").to_pylist())
            for i in range(0, len(q), FEW):
                s = slice(i, i + FEW)
                sums = np.zeros(far[s].shape, np.int64)
                for j in range(0, len(other), FEW):
                    sums += nearer_than(q[s], v[s], far[s], ids[s], other[j : j + FEW], rows[j : j + FEW])
                out.append(pa.table({"q": np.repeat(q[s], n[s]), "id": ids[s][held[s]], "n": sums[held[s]]}))
        return pa.concat_tables(out)

    key = ["cell", "wave"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(count, "q long, id long, n long")
    return met.unionAll(unmet).groupBy("q", "id").agg((F.sum("n") + 1).alias("rank"))
