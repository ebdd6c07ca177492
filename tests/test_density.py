"""The index of balls, spanning trees, condensed trees, prediction and validity against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from lociworks.operators import balls, density, neighbours


def blobs(seed: int = 1, n: int = 120) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [((0, 0), 0.35, 3), ((5, 5), 0.9, 3), ((-4, 6), 0.2, 6), ((8, -3), 1.4, 6)]
    return np.round(np.concatenate([rng.normal(c, s, (n // k, 2)) for c, s, k in parts] + [rng.uniform(-8, 12, (n // 10, 2))]), 3)


def frame(spark, v: np.ndarray, name: str = "id"):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(v)], f"{name} long, v array<double>")


def slow_nearest(q: np.ndarray, v: np.ndarray, k: int, itself: bool) -> set:
    out = set()
    for i, x in enumerate(q):
        d = sorted((round(float(np.sqrt(((x - y) ** 2).sum())), balls.DIGITS), j) for j, y in enumerate(v) if itself or j != i)
        out |= {(i, j, w, place) for place, (w, j) in enumerate(d[:k], 1)}
    return out


@pytest.mark.parametrize("cell, k, itself", [(2048, 5, False), (7, 12, True)])
def test_index_equals_brute_force(spark, monkeypatch, cell, k, itself):
    monkeypatch.setattr(balls, "CELL", cell)
    monkeypatch.setattr(balls, "WAVE", 9)
    v = np.concatenate([blobs(), np.repeat([[1.0, 1.0]], 60, axis=0), [[500, 500]]])  # a third are copies
    index = balls.build(frame(spark, v), "id", "v")
    found = balls.nearest(frame(spark, v, "q"), index, k, itself)
    assert {(r.q, r.id, r.distance, r.place) for r in found.collect()} == slow_nearest(v, v, k, itself)
    share = balls.met_share(frame(spark, v, "q"), index, k, itself).first()
    assert share.pairs == len(v) ** 2 and 0 < share.met < share.pairs and share.pruned == pytest.approx(1 - share.met / share.pairs)


def test_index_of_few_or_no_rows(spark):
    v = np.array([[0.0, 0.0], [3.0, 4.0]])
    near = neighbours.knn_join(frame(spark, v), frame(spark, v), 5, "id", "v")
    assert {(r.q, r.id, r.distance) for r in near.collect()} == {(0, 1, 5.0), (1, 0, 5.0)}
    none = frame(spark, v).where("id < 0")
    assert neighbours.knn_join(frame(spark, v), none, 5, "id", "v").count() == 0
    assert neighbours.knn_join(none, frame(spark, v), 5, "id", "v").count() == 0
    assert neighbours.knn_join(frame(spark, v), spark.createDataFrame([(7, None), (8, [3.0, 4.0])], "id long, v array<double>"), 5, "id", "v").count() == 2


def slow_core(v: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)), balls.DIGITS)
    return d, np.sort(d, axis=1)[:, min(samples, len(v)) - 1]


def slow_tree(v: np.ndarray, samples: int) -> list:
    d, core = slow_core(v, samples)
    w = np.maximum(np.maximum(d, core[:, None]), core[None])
    edges = sorted((float(w[a, b]), a, b) for a in range(len(v)) for b in range(a + 1, len(v)))
    part, out = list(range(len(v))), []
    for e in edges:
        if part[e[1]] != part[e[2]]:
            old, new = part[e[1]], part[e[2]]
            part = [new if p == old else p for p in part]
            out.append(e)
    return out


def slow_condense(edges: list, n: int, least: int) -> tuple[dict, dict]:
    """From the top down: cut the heaviest edge of each part, again and again. (points to their cluster's members and density, clusters by members)"""
    points, clusters = {}, {}

    def parts_of(members, own):
        up = {m: m for m in members}

        def find(x):
            return x if up[x] == x else find(up[x])

        for _, a, b in own:
            up[find(a)] = find(b)
        groups = {}
        for m in members:
            groups.setdefault(find(m), []).append(m)
        return [(g, [e for e in own if e[1] in set(g)]) for g in groups.values()]

    def walk(members, own, birth, parent):
        key = frozenset(members)
        clusters[key] = [birth, parent, 0.0]
        now, rest = members, own
        while rest:
            w = rest[-1][0]
            lam = density.density(w)
            split = parts_of(now, rest[:-1])
            large = [(g, o) for g, o in split if len(g) >= least]
            for g, _ in split:
                if len(g) < least:
                    points.update({m: (key, lam) for m in g})
                    clusters[key][2] += len(g) * (lam - birth)
            if len(large) == 2:
                for g, o in large:
                    clusters[key][2] += len(g) * (lam - birth)
                    walk(g, o, lam, key)
                return
            if not large:
                return
            now, rest = large[0]

    walk(list(range(n)), sorted(edges), 0.0, None)
    return points, clusters


@pytest.mark.parametrize("seed, samples, least", [(1, 5, 5), (2, 3, 8), (3, 1, 2)])
def test_condensed_tree_equals_cutting_from_the_top(seed, samples, least):
    v = blobs(seed, 60)
    edges = slow_tree(v, samples)
    points, clusters = density.condense(edges, list(range(len(v))), least)
    want_points, want_clusters = slow_condense(edges, len(v), least)
    below = {c[0]: set() for c in clusters}
    for p, c, _ in points:
        while True:
            below[c].add(p)
            up = next(k[1] for k in clusters if k[0] == c)
            if up == c:
                break
            c = up
    key = {c: frozenset(m) for c, m in below.items()}
    assert {p: (key[c], round(lam, 9)) for p, c, lam in points} == {p: (k, round(lam, 9)) for p, (k, lam) in want_points.items()}
    got = {key[c[0]]: (round(c[2], 9), c[3], round(c[4], 6)) for c in clusters}
    assert got == {k: (round(b, 9), len(k), round(m, 6)) for k, (b, _, m) in want_clusters.items()}
    chosen = [key[c[0]] for c in clusters if c[8]]
    assert all(not a & b for i, a in enumerate(chosen) for b in chosen[:i])  # none lies in another

    def best(k):
        return max(want_clusters[k][2], sum(best(c) for c, x in want_clusters.items() if x[1] == k))

    root = next(k for k, x in want_clusters.items() if x[1] is None)
    assert sum(want_clusters[k][2] for k in chosen) == pytest.approx(sum(best(c) for c, x in want_clusters.items() if x[1] == root))


def test_tree_and_prediction(spark):
    v = blobs(5)
    fit = frame(spark, v)
    own = density.with_core(fit, 5)
    assert [tuple(e) for e in density.spanning_tree(own)] == [pytest.approx(e) for e in slow_tree(v, 5)]
    points, clusters = density.fit_tree(fit, 5)
    rows = {c.cluster: c for c in clusters.collect()}
    at = {p.id: p for p in points.collect()}
    rng = np.random.default_rng(9)
    q = np.concatenate([v[::3], rng.uniform(-12, 16, (40, 2)), [[500, 500], [-400, 250]]])
    d, core = slow_core(v, 5)
    for r in density.predict(frame(spark, q, "q"), points, clusters, 5).collect():
        near = sorted((round(float(np.sqrt(((q[r.q] - y) ** 2).sum())), balls.DIGITS), j) for j, y in enumerate(v))[:10]
        reach = [(max(w, core[j], near[5][0]), place, j) for place, (w, j) in enumerate(near)]
        w, _, j = min(reach)
        lam, c = density.density(w), at[j].cluster
        if at[j]["lambda"] > lam:
            while rows[c].parent != c and rows[c].birth >= lam:
                c = rows[c].parent
        assert r.cluster_label == rows[c].label
        assert r.cluster_probability == pytest.approx(min(rows[c].max_lambda, lam) / rows[c].max_lambda if rows[c].label >= 0 else 0)
    far = density.predict(frame(spark, np.array([[500.0, 500], [1000, -1000]]), "q"), points, clusters, 5).collect()
    assert {(r.cluster_label, r.cluster_probability) for r in far} == {(-1, 0.0)}
    with pytest.raises(ValueError):
        density.spanning_tree(own, most=10)


def test_validity_tells_separate_from_mixed(spark):
    v = blobs(7, 60)
    n = len(v) - 6
    label = np.repeat([0, 1, 2, 3], [20, 20, 10, 10])
    rows = [(i, [float(x) for x in v[i]], int(label[i]) if i < n else -1) for i in range(len(v))]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    good = density.validity(df)
    assert {r.label: (r.size, r.sampled) for r in good.collect()} == {0: (20, 20), 1: (20, 20), 2: (10, 10), 3: (10, 10)}
    mixed = density.validity(df.selectExpr("id", "v", "cast(id % 3 as int) label"))
    assert density.validity_summary(good).first().dbcv > 0 > density.validity_summary(mixed).first().dbcv
    assert density.validity_summary(mixed).first().point_share_negative == 1
    one = density.validity(df.selectExpr("id", "v", "0 label")).first()
    assert one.separation is None and one.score is None


@pytest.mark.parametrize("cell", [2048, 6])
def test_ranks_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(balls, "CELL", cell)
    v = np.concatenate([blobs(3), np.repeat([[1.0, 1.0]], 40, axis=0), [[500, 500]]])
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, len(v), (300, 2)) if a != b} | {(len(v) - 1, 0), (len(v) - 2, len(v) - 3), (0, len(v) - 1)}
    got = balls.ranks(spark.createDataFrame(sorted(pairs), "q long, id long"), frame(spark, v), "id", "v").collect()
    place = {(i, j): p for i, j, _, p in slow_nearest(v, v, len(v), False)}
    assert {(r.q, r.id): r["rank"] for r in got} == {p: place[p] for p in pairs}
