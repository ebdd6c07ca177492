"""Density of clusterings: mutual reachability, its least spanning tree, the condensed tree, and validity.

The mutual reachability of two points is the greatest of their distance and both
core distances. Trees are made of all points; validity is worked out on a sample, whose
bound is a parameter. Distances are rounded, and ties between edges go by weight,
then the lower end, then the higher, so a tree is the same for any number of tasks.

Trees. Points lie in cells. Each cell has its own least spanning tree, and each pair of
cells a task that finds the tree of both: an edge between two points enters a tree only
if it is less than the greatest edge on the way between them, of which the greater of
both ways to the tree's root is a bound, so most pairs need no exact distance. The
whole tree is among the edges of all these. It is taken from them by rounds that each
join every part to its nearest other, until few edges are left for one task.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from . import balls, sampling

#: Rows of a block; each pair of blocks is one group of a search.
BLOCK = 1024
#: Edges that spanning_tree() brings to the driver at most, less one, and rows of each cluster that validity looks at.
TREE_ROWS, CLUSTER_ROWS = 20_000, 256
#: Rows of a cell of a tree at most, cells that are wanted where there are few rows, and rows of a cell that are compared at a time.
TREE_CELL, TREE_CELLS, TREE_PART = 32768, 16, 2048
#: Edges from which one task takes the least spanning tree; of more, parts are joined in rounds.
FINISH = 2_000_000
#: Least rows of a cluster in the condensed tree.
LEAST = 5


def with_core(points: DataFrame, samples: int) -> DataFrame:
    """points (id, v) with core: the distance of the samples-th nearest point, itself counted, or of the last where there are fewer."""
    near = balls.nearest(points.select(F.col("id").alias("q"), "v"), balls.build(points, "id", "v"), samples, itself=True)
    return points.join(near.groupBy(F.col("q").alias("id")).agg(F.max("distance").alias("core")), "id")


def nearest_other(points: DataFrame) -> DataFrame:
    """(id, other, w) of points (id, v, core, part): the least edge from each point to one of another part; none where there is no other part.

    All pairs of blocks are compared, each in its own task's memory.
    """
    blocks = max(1, math.ceil(points.count() / BLOCK))
    own = points.withColumn("_block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left, right = own.withColumnRenamed("_block", "a").withColumn("b", every), own.withColumnRenamed("_block", "b").withColumn("a", every)

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        none = pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        if not x.num_rows or not y.num_rows:
            return none
        column = lambda t, c: t.column(c).to_numpy()
        v, others, core, its_core = balls.matrix(x.column("v")), balls.matrix(y.column("v")), column(x, "core"), column(y, "core")

        def reach(side: int) -> np.ndarray:
            """Squares of mutual reachability from below or above, infinite within a part."""
            w = np.maximum(np.maximum(balls.squares(v, others, side), (core**2)[:, None]), (its_core**2)[None])
            w[column(x, "part")[:, None] == column(y, "part")[None]] = np.inf
            return w

        least = reach(1).min(1)
        some = np.flatnonzero(np.isfinite(least))
        i, j = np.nonzero(reach(-1)[some] <= balls.reached(np.sqrt(least[some]))[:, None])
        i = some[i]
        w = np.maximum(np.maximum(balls.pairs_apart(v, others, i, j), core[i]), its_core[j])
        order = np.lexsort((column(y, "id")[j], w, i))  # the lowest id of those that are nearest
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        return pa.table({"id": column(x, "id")[i[first]], "other": column(y, "id")[j[first]], "w": w[first]}) if len(first) else none

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(search, "id long, other long, w double")
    least = found.groupBy("id").agg(F.min(F.struct("w", "other")).alias("e"))
    return least.select("id", F.col("e.other").alias("other"), F.col("e.w").alias("w"))


class Parts:
    """Which part each point belongs to, as parts are joined; points are numbered from 0."""

    def __init__(self, n: int) -> None:
        self._up = array("q", range(n))

    def of(self, x: int) -> int:
        up = self._up
        while (to := up[x]) != x:
            up[x] = x = up[to]
        return x

    def join(self, a: int, b: int) -> int:
        """Joins the parts a and b under the lower number, which it returns."""
        a, b = (a, b) if a < b else (b, a)
        self._up[b] = a
        return a


def least_forest(n: int, lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, w) of the least spanning forest of n points by given edges lo < hi, the lightest first."""
    order = np.lexsort((hi, lo, w))
    lo, hi, w = lo[order], hi[order], w[order]
    part, left, taken = np.arange(n), np.arange(len(w)), np.zeros(len(w), dtype=bool)
    while True:
        a, b = part[lo[left]], part[hi[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return lo[taken], hi[taken], w[taken]
        best = np.full(n, len(left))
        np.minimum.at(best, a, np.arange(len(left)))
        np.minimum.at(best, b, np.arange(len(left)))
        own = np.flatnonzero(best < len(left))
        taken[left[best[own]]] = True
        to = np.arange(n)
        to[own] = a[best[own]] + b[best[own]] - own
        both = own[(to[to[own]] == own) & (own < to[own])]  # two parts that chose the same edge; there are no other circles
        to[both] = both
        while (to != to[to]).any():
            to = to[to]
        part = to[part]


def greatest_to_root(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For each point of a tree whose edges are in order the number of the last of them on the way to an end of the first; -1 for that end."""
    ends = np.concatenate([lo, hi])
    order = np.argsort(ends, kind="stable")
    begin = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    edge, other = (order % len(lo)).tolist(), np.concatenate([hi, lo])[order].tolist()
    last, seen, stack = [-1] * n, bytearray(n), [int(lo[0])]
    seen[stack[0]] = 1
    while stack:
        x = stack.pop()
        for k in range(begin[x], begin[x + 1]):
            y = other[k]
            if not seen[y]:
                seen[y] = 1
                last[y] = edge[k] if edge[k] > last[x] else last[x]
                stack.append(y)
    return np.array(last)


Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


class Growing:
    """The least spanning tree of points that are in order of their ids, as pairs of parts are compared."""

    def __init__(self, v: np.ndarray, core: np.ndarray) -> None:
        self.v, self.core = v, core

    def _exact(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(balls.pairs_apart(self.v, self.v, i, j), self.core[i]), self.core[j])

    def _take(self, tree: Tree, new: list[Tree]) -> Tree:
        return least_forest(len(self.v), *map(np.concatenate, zip(tree, *new)))

    def _reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Squares of mutual reachability, about."""
        d = np.maximum(np.maximum(balls.squares(self.v[a], self.v[b], -1), (self.core[a] ** 2)[:, None]), (self.core[b] ** 2)[None])
        return np.where(np.isnan(d), np.inf, d)

    def of_part(self, at: np.ndarray) -> Tree:
        """The tree of one part: any light tree first, which few and then all of its rows are compared by."""
        tree = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(at) < 2:
            return tree
        d = self._reach(at, at)
        np.fill_diagonal(d, np.inf)
        i, j = np.concatenate([at, np.full(len(at) - 1, at[0])]), np.concatenate([at[d.argmin(1)], at[1:]])
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j = i[i < j], j[i < j]
        tree = self._take(tree, [(i, j, self._exact(i, j))])
        return self.compare(tree, [(at, [at[:128]]), (at, [at])])

    def bridge(self, a: np.ndarray, b: np.ndarray) -> Tree:
        """A light edge between two parts, of which one at least must be in a tree that spans both."""
        a, b = a[:TREE_PART], b[:TREE_PART]
        i, j = np.unravel_index(self._reach(a, b).argmin(), (len(a), len(b)))
        x, y = np.array([min(a[i], b[j])]), np.array([max(a[i], b[j])])
        return x, y, self._exact(x, y)

    def compare(self, tree: Tree, pairs: list[tuple[np.ndarray, list[np.ndarray]]]) -> Tree:
        """The tree after each part has been compared with others; tree spans all points."""
        for x, others in pairs:
            lo, hi, w = tree
            last = greatest_to_root(len(self.v), lo, hi)
            most = np.where(last >= 0, w[last], 0.0)
            far, new = balls.reached(most), []
            for y in others:
                i, j = np.nonzero(balls.squares(self.v[x], self.v[y], -1) <= np.maximum(far[x][:, None], far[y][None]))
                i, j = x[i], y[j]
                for at in range(0, len(i), balls.CHUNK):
                    a, b = np.minimum(i[at : at + balls.CHUNK], j[at : at + balls.CHUNK]), np.maximum(i[at : at + balls.CHUNK], j[at : at + balls.CHUNK])
                    e = np.maximum(last[a], last[b])
                    ok = (a < b) & (np.maximum(self.core[a], self.core[b]) <= w[e])
                    a, b, e = a[ok], b[ok], e[ok]
                    d = self._exact(a, b)
                    less = (d < w[e]) | ((d == w[e]) & ((a < lo[e]) | ((a == lo[e]) & (b < hi[e]))))
                    new.append((a[less], b[less], d[less]))
            tree = self._take(tree, new)
        return tree


def _cut(at: np.ndarray) -> list[np.ndarray]:
    return [at[i : i + TREE_PART] for i in range(0, len(at), TREE_PART)]


def _points(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return t.column("id").to_numpy(), balls.matrix(t.column("v")), t.column("core").to_numpy()


def _tree_within(t: pa.Table) -> pa.Table:
    """The points of a cell in order of their ids; all but the last carry an edge of the cell's tree."""
    t = t.sort_by("id")
    ids, v, core = _points(t)
    grown, parts = Growing(v, core), _cut(np.arange(len(ids)))
    tree = grown._take(grown.of_part(parts[0]), [x for p in parts[1:] for x in (grown.of_part(p), grown.bridge(parts[0], p))])
    if len(parts) > 1:
        tree = grown.compare(tree, [(p, parts[k + 1 :]) for k, p in enumerate(parts[:-1])])
    lo, hi, w = tree
    filled = lambda x, kind: pa.array([*x.tolist(), *[None] * (len(ids) - len(x))], kind)
    for name, x, kind in (("a", ids[lo], pa.int64()), ("b", ids[hi], pa.int64()), ("w", w, pa.float64())):
        t = t.append_column(name, filled(x, kind))
    return t


def _tree_between(x: pa.Table, y: pa.Table) -> pa.Table:
    """Edges between two cells that are in the tree of both."""
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
    if not x.num_rows or not y.num_rows:
        return none
    both = pa.concat_tables([t.select(["id", "v", "core", "a", "b", "w"]).append_column("side", pa.array([k] * t.num_rows, pa.int8())) for k, t in enumerate((x, y))]).sort_by("id")
    ids, v, core = _points(both)
    side = both.column("side").to_numpy()
    own = both.filter(pc.is_valid(both.column("w")))
    ends = [np.searchsorted(ids, own.column(c).to_numpy()) for c in ("a", "b")]
    left, right = (_cut(np.flatnonzero(side == k)) for k in (0, 1))
    grown = Growing(v, core)
    tree = grown._take((*ends, own.column("w").to_numpy()), [grown.bridge(left[0], right[0])])
    lo, hi, w = grown.compare(tree, [(p, right) for p in left])
    met = side[lo] != side[hi]
    return pa.table({"a": ids[lo[met]], "b": ids[hi[met]], "w": w[met]})


def tree_edges(points: DataFrame) -> DataFrame:
    """(a, b, w), written down, of the least spanning tree of any number of points (id, v, core)."""
    n = points.count()
    cells = max(1, math.ceil(n / TREE_CELL), min(TREE_CELLS, math.ceil(n / TREE_PART)))
    dealt = points.select("id", "v", "core", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"))
    held = checkpointed(dealt.groupBy("cell").applyInArrow(_tree_within, "id long, v array<double>, core double, cell int, a long, b long, w double"))
    edges = held.where("w IS NOT NULL").select("a", "b", "w")
    if cells > 1:
        left = held.where(F.col("cell") < cells - 1).select("*", F.explode(F.sequence(F.col("cell") + 1, F.lit(cells - 1))).alias("other"))
        right = held.where("cell > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("cell") - 1)).alias("other"))
        met = left.groupBy("cell", "other").cogroup(right.groupBy("other", "cell")).applyInArrow(_tree_between, "a long, b long, w double")
        edges = edges.unionAll(met)
    return least_tree(checkpointed(edges))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least spanning tree of the parts that edges (x, y, a, b, w) join."""
    t = pa.Table.from_batches(batches, pa.schema([(c, pa.int64()) for c in ("x", "y", "a", "b")] + [("w", pa.float64())]))
    x, y, a, b, w = (c.to_numpy() for c in t.columns)
    # edges are in order of (w, a, b), so their places are weights without ties
    order = np.lexsort((b, a, w))
    parts, at = np.unique(np.concatenate([x[order], y[order]]), return_inverse=True)
    i, j = at[: len(x)], at[len(x) :]
    taken = order[least_forest(len(parts), np.minimum(i, j), np.maximum(i, j), np.arange(len(x)))[2]]
    yield pa.RecordBatch.from_arrays([pa.array(a[taken]), pa.array(b[taken]), pa.array(w[taken])], ["a", "b", "w"])


def least_tree(edges: DataFrame) -> DataFrame:
    """(a, b, w), written down: the least spanning tree by edges (a, b, w).

    A round joins every part to its nearest other, at least halves the parts, and leaves the least edge between any two.
    """
    left, out = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "w"), None
    while left.count() > FINISH:
        e = F.struct("w", "a", "b").alias("e")
        both = left.select("x", "y", e).unionAll(left.select(F.col("y").alias("x"), F.col("x").alias("y"), e))
        best = checkpointed(both.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", F.col("m.y").alias("y"), "m.e"))
        taken = best.select("e.a", "e.b", "e.w").distinct()
        out = taken if out is None else out.unionAll(taken)
        # the two parts that chose the same edge have the lower one for a root; others follow theirs
        back = best.select(F.col("x").alias("y"), F.col("y").alias("_back"))
        up = checkpointed(best.join(back.hint("merge"), "y").select("x", F.when((F.col("_back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("up")))
        while True:
            higher = up.select(F.col("x").alias("up"), F.col("up").alias("top"))
            now = checkpointed(up.join(higher.hint("merge"), "up").select("x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            up = now.select("x", "up")
            if now.where("moved").isEmpty():
                break
        root = lambda c: up.select(F.col("x").alias(c), F.col("up").alias(f"_{c}")).hint("merge")
        moved = left.join(root("x"), "x").join(root("y"), "y").where("_x <> _y")
        kept = moved.groupBy(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        left = checkpointed(kept.select("x", "y", "e.a", "e.b", "e.w"))
    last = left.coalesce(1).mapInArrow(_finish, "a long, b long, w double")
    return checkpointed(last if out is None else out.unionAll(last))


def spanning_tree(points: DataFrame, most: int = TREE_ROWS) -> list[tuple[float, int, int]]:
    """(w, a, b) of the least spanning tree of few points (id, v, core), the lightest first, on the driver."""
    n = points.count()
    if n > most:
        raise ValueError(f"a tree of {n} points on the driver, which takes at most {most}: tree_edges has no bound")
    return sorted((r.w, r.a, r.b) for r in tree_edges(points).collect())


def density(w: float) -> float:
    """Lambda, the density at which an edge breaks."""
    return 1 / w if w > 0 else np.finfo(np.float64).max


def condense(edges: list[tuple[float, int, int]], ids: list[int], least: int = LEAST) -> tuple[list[tuple], list[tuple]]:
    """The condensed tree of a spanning tree: points (id, cluster, lambda) and clusters (cluster, parent, birth, size, stability, persistence, label, max_lambda).

    Edges join from the lightest on. A part becomes a cluster when it first has ``least`` points; smaller parts that join
    a cluster fall out of it at that density; where two clusters meet both end there and a larger one begins. Clusters
    are numbered from 1 in that order, the last is the root, and is its own parent. Those whose mass exceeds that of all
    chosen clusters within them are chosen, the root never; clusters within a chosen one share its label and greatest lambda.
    Labels are in the order of the chosen clusters' least points.
    """
    ids, weights = np.sort(np.array(ids, np.int64)), np.array([e[0] for e in edges])
    ends = [np.searchsorted(ids, np.array([e[k] for e in edges], np.int64)) for k in (1, 2)]
    at, lam, clusters = condensed(len(ids), *ends, weights, least)
    some = np.flatnonzero(at)
    return list(zip(ids[some].tolist(), at[some].tolist(), lam[some].tolist())), clusters


def condensed(n: int, lo: np.ndarray, hi: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """condense() of points 0 to n - 1 and edges lo < hi: (cluster or 0, lambda) of each point, and the clusters. Some 100 bytes a point."""
    order = np.lexsort((hi, lo, w))
    parts, size, cluster = Parts(n), array("q", [1]) * n, array("q", [0]) * n
    members: dict[int, list[int]] = {}  # of parts of two points or more that are in no cluster
    fallen, fell = array("q", [0]) * n, array("d", [0.0]) * n
    parent: dict[int, int] = {}
    birth: dict[int, float] = {}
    total: dict[int, int] = {}
    children: dict[int, list[int]] = {}
    for at in range(0, n - 1, 1 << 16):
        some = order[at : at + (1 << 16)]
        for a, b, each in zip(lo[some].tolist(), hi[some].tolist(), w[some].tolist()):
            x, y = parts.of(a), parts.of(b)
            cx, cy, lam, both = cluster[x], cluster[y], density(each), size[x] + size[y]
            if cy and not cx:
                x, y, cx, cy = y, x, cy, cx
            now = cx
            if (cx and cy) or (not cx and both >= least):
                now = len(children) + 1
                children[now] = [c for c in (min(cx, cy), max(cx, cy)) if c]
                for c in children[now]:
                    parent[c], birth[c] = now, lam
            held = [*([] if cx else members.pop(x, [x])), *([] if cy else members.pop(y, [y]))]
            if now:
                total[now] = both
                for p in held:
                    fallen[p], fell[p] = now, lam
            z = parts.join(x, y)
            size[z], cluster[z] = both, now
            if not now:
                members[z] = held
    fallen, fell = np.array(fallen), np.array(fell)
    root = len(children)
    if root:
        parent[root], birth[root] = root, 0.0
    known = np.array([0.0, *[birth[c] for c in children]])
    some = np.flatnonzero(fallen)
    sums, tops, firsts = np.zeros(root + 1), np.zeros(root + 1), np.full(root + 1, n)
    np.add.at(sums, fallen[some], fell[some] - known[fallen[some]])
    np.maximum.at(tops, fallen[some], fell[some])
    np.minimum.at(firsts, fallen[some], some)
    mass, top, least_point = (dict(enumerate(x.tolist())) for x in (sums, tops, firsts))
    for c in children:
        for k in children[c]:
            mass[c] += total[k] * (birth[k] - birth[c])
            top[c], least_point[c] = max(top[c], birth[k]), min(least_point[c], least_point[k])
    best, chosen = dict(mass), {}
    for c in children:  # those within come first
        within = sum(best[k] for k in children[c])
        chosen[c] = c != root and within <= mass[c]
        best[c] = max(mass[c], within)
    above: dict[int, int] = {}
    for c in sorted(children, reverse=True):
        above[c] = above.get(parent[c], 0) if c != root else 0
        above[c] = above[c] or (c if chosen[c] else 0)
    label = {c: i for i, c in enumerate(sorted({a for a in above.values() if a}, key=lambda c: least_point[c]))}
    highest = max(top.values(), default=0.0)
    clusters = [
        (c, parent[c], birth[c], total[c], mass[c], mass[c] / (total[c] * highest) if highest else 1.0, label.get(above[c], -1), top[above[c] or c], above[c] == c)
        for c in children
    ]
    return fallen, fell, clusters


CLUSTERS = "cluster int, parent int, birth double, size long, stability double, persistence double, label int, max_lambda double, chosen boolean"


def fit_tree(points: DataFrame, samples: int, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The stored model of points (id, v), any number of them: (id, v, core, cluster, lambda) and its clusters.

    Edges are condensed one after the other, so in one task, which holds numbers of all edges and no vectors.
    """
    own = checkpointed(with_core(points, samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())]))
        a, b, w = (c.to_numpy() for c in t.columns)
        ids = np.unique(np.concatenate([a, b]))
        at, lam, clusters = condensed(len(ids), np.searchsorted(ids, a), np.searchsorted(ids, b), w, least)
        some = np.flatnonzero(at)
        fallen = pa.table({"id": ids[some], "cluster": pa.array(at[some], pa.int32()), "lambda": lam[some]})
        columns = zip(*clusters) if clusters else [[]] * len(kinds)
        made = pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds.items(), columns)})
        for part in (fallen, made):
            part = pa.table({f.name: part.column(f.name) if f.name in part.column_names else pa.nulls(part.num_rows, f.type) for f in whole})
            yield from part.to_batches(max_chunksize=1 << 16)

    kinds = dict(zip([c.split()[0] for c in CLUSTERS.split(", ")], [pa.int32()] * 2 + [pa.float64(), pa.int64()] + [pa.float64()] * 2 + [pa.int32(), pa.float64(), pa.bool_()]))
    whole = pa.schema([("id", pa.int64()), ("lambda", pa.float64()), *kinds.items()])
    found = checkpointed(tree_edges(own).coalesce(1).mapInArrow(run, f"id long, lambda double, {CLUSTERS}"))
    fallen = found.where("id IS NOT NULL").select("id", "cluster", "lambda")
    clusters = found.where("id IS NULL").select(*kinds)
    return checkpointed(own.join(fallen, "id", "left")), checkpointed(clusters)


def predict(queries: DataFrame, points: DataFrame, clusters: DataFrame, samples: int, index: balls.Index | None = None) -> DataFrame:
    """(q, cluster_label, cluster_probability) of queries (q, v) by a stored tree.

    Of the 2 * samples nearest points, the one of least mutual reachability counts, the first of equals. From its
    cluster the query climbs while clusters were born at its own density or more.
    """
    k = 2 * samples
    near = balls.nearest(queries, index or balls.build(points, "id", "v"), k, itself=True)
    met = near.join(points.select("id", "core", "cluster", "lambda"), "id")
    of_query = met.groupBy("q").agg(
        F.max(F.when(F.col("place") <= samples + 1, F.col("distance"))).alias("own"),
        F.collect_list(F.struct("place", "distance", "core", "cluster", "lambda")).alias("near"),  # k rows
    )
    reach = F.transform("near", lambda x: F.struct(F.greatest(x["distance"], x["core"], F.col("own")).alias("w"), x["place"].alias("place"), x["cluster"].alias("cluster"), x["lambda"].alias("lambda")))
    best = of_query.select("q", F.array_min(reach).alias("b")).select("q", "b.*")
    lam = F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(float(np.finfo(np.float64).max)))
    # all clusters within a chosen one share its label; whoever climbs ends there, or above, where nothing is chosen
    chosen = clusters.where("chosen").select("label", F.col("birth").alias("_born"))
    told = clusters.join(chosen, "label").select("cluster", "label", "max_lambda", "_born")
    out = best.withColumn("lam", lam).join(told, "cluster", "left")
    leaves = (F.col("lambda") > F.col("lam")) & (F.col("_born") >= F.col("lam"))
    label = F.when(leaves, -1).otherwise(F.coalesce("label", F.lit(-1)))
    share = F.when(F.col("max_lambda") > 0, F.least("max_lambda", "lam") / F.col("max_lambda")).otherwise(1.0)
    return out.select("q", label.cast("int").alias("cluster_label"), F.when(label >= 0, share).otherwise(0.0).alias("cluster_probability"))


def _cluster_density(d: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(core, internal, sparseness) of one cluster from its points' distances; the least spanning tree grows from the first point."""
    n = len(d)
    with np.errstate(divide="ignore", over="ignore"):
        inverse = np.where(d > 0, 1 / np.where(d > 0, d, 1) ** width, 0.0)
        total = inverse.sum(1) / max(1, n - 1)
        core = np.round(np.where(total > 0, np.where(total > 0, total, 1) ** (-1 / width), 0.0), balls.DIGITS)
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    within, edges = np.zeros(n, dtype=bool), []
    within[0] = True
    best, source = w[0].copy(), np.zeros(n, dtype=int)
    for _ in range(n - 1):
        order = np.where(within, np.inf, best)
        b = min(np.flatnonzero(order == order.min()), key=lambda x: (source[x], x))
        edges.append((best[b], source[b], b))
        within[b] = True
        nearer = (w[b] < best) | ((w[b] == best) & (b < source))
        best, source = np.where(nearer, w[b], best), np.where(nearer, b, source)
    degree = np.bincount([x for _, a, b in edges for x in (a, b)], minlength=n)
    internal = degree > 1
    if not internal.any():
        internal[0] = True
    inner = [e[0] for e in edges if internal[e[1]] and internal[e[2]]] or [e[0] for e in edges]
    return core, internal, max(inner, default=0.0)


def validity(points: DataFrame, per_cluster: int = CLUSTER_ROWS, seed: int = 0) -> DataFrame:
    """(label, size, sampled, sparseness, separation, score) of points (id, v, label), negative labels being noise.

    Density-based validity over at most per_cluster rows of each cluster: (separation - sparseness) / the greater of both.
    Sparseness is the heaviest inner edge of a cluster's least spanning tree, separation the least edge from its inner
    points to another cluster's; distances of all points of a cluster enter their core distances in the power of the width.
    A single cluster has no separation and no score.
    """
    labelled = points.where(F.col("label") >= 0)
    sizes = labelled.groupBy("label").agg(F.count("*").alias("size"))
    chosen = sampling.stratified_sample(labelled, "label", ["id"], per_cluster, seed).select("id", "v", "label")

    def measure(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        v = balls.matrix(t.column("v"))
        core, internal, sparse = _cluster_density(np.round(balls.apart(v, v), balls.DIGITS), v.shape[1])
        n = t.num_rows
        return t.append_column("core", pa.array(core)).append_column("internal", pa.array(internal)).append_column("sparseness", pa.array([float(sparse)] * n)).append_column("sampled", pa.array([n] * n, pa.int64()))

    schema = f"id long, v array<double>, label {points.schema['label'].dataType.simpleString()}, core double, internal boolean, sparseness double, sampled long"
    made = checkpointed(chosen.groupBy("label").applyInArrow(measure, schema))
    inner = made.where("internal").select("id", "v", "core", F.col("label").alias("part"))
    gaps = nearest_other(inner).join(inner.select("id", F.col("part").alias("label")), "id").groupBy("label").agg(F.min("w").alias("separation"))
    clusters = made.groupBy("label").agg(F.max("sparseness").alias("sparseness"), F.max("sampled").alias("sampled"))
    met = sizes.join(clusters, "label").join(gaps, "label", "left")
    score = F.when(F.greatest("separation", "sparseness") > 0, (F.col("separation") - F.col("sparseness")) / F.greatest("separation", "sparseness"))
    return met.select("label", "size", "sampled", "sparseness", "separation", score.alias("score"))


def validity_summary(scores: DataFrame) -> DataFrame:
    """One row over validity(): the mean by true sizes, by sampled ones and of clusters alike, the least, and the shares of clusters and of points below 0."""
    known = scores.where("score IS NOT NULL")
    by: Callable = lambda n: F.sum(F.col("score") * F.col(n)) / F.sum(n)
    below = F.col("score") < 0
    return known.agg(
        by("size").alias("dbcv"),
        by("sampled").alias("dbcv_sample_weighted"),
        F.avg("score").alias("dbcv_unweighted_mean"),
        F.min("score").alias("dbcv_cluster_min"),
        F.avg(below.cast("double")).alias("frac_clusters_negative"),
        (F.sum(F.when(below, F.col("size")).otherwise(0)) / F.sum("size")).alias("point_share_negative"),
    )
