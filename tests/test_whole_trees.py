"""Trees of all points, however many: parts and cells, rounds, and the queries that stand on them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from lociworks.operators import density
from lociworks.plans import registry

from test_density import blobs, frame, slow_core, slow_tree

FOLDER = "/root/testdata/sf0.001"


def points() -> np.ndarray:
    return np.concatenate([blobs(4), np.repeat([[1.0, 1.0]], 40, axis=0), [[500, 500]]])  # copies, which tie


def test_parts_and_pairs_of_cells(monkeypatch):
    """what tasks do, with cells of some parts."""
    monkeypatch.setattr(density, "TREE_PART", 13)
    v = points()
    core = slow_core(v, 3)[1]
    t = pa.table({"id": np.arange(len(v)), "v": list(v), "core": core})
    cell = np.random.default_rng(1).integers(0, 3, len(v))
    own = [density._tree_within(t.filter(pa.array(cell == k))) for k in range(3)]
    between = [density._tree_between(own[a], own[b]) for a, b in ((0, 1), (0, 2), (1, 2))]
    edges = pa.concat_tables([x.filter(pa.compute.is_valid(x.column("w"))).select(["a", "b", "w"]) for x in own] + between)
    a, b, w = (c.to_numpy() for c in edges.columns)
    got = list(zip(*(x.tolist() for x in density.least_forest(len(v), a, b, w))))
    assert [(w, a, b) for a, b, w in got] == slow_tree(v, 3)
    assert edges.num_rows < 4 * len(v)  # few are sent on


def test_a_tree_of_many_cells_and_rounds(spark, monkeypatch):
    """F3, F6, F7."""
    monkeypatch.setattr(density, "TREE_CELL", 60)
    monkeypatch.setattr(density, "FINISH", 60)
    v = points()
    own = density.with_core(frame(spark, v), 3)
    assert sorted((r.w, r.a, r.b) for r in density.tree_edges(own).collect()) == slow_tree(v, 3)


@pytest.mark.parametrize("name", ["spanning_tree", "condensed_tree", "predict_clusters"])
def test_no_row_is_left_out_of_a_tree(spark, monkeypatch, name):
    """every row is in the tree, also beyond what the driver takes."""
    monkeypatch.setattr(density, "TREE_ROWS", 50)
    fitted, real = [], density.tree_edges
    monkeypatch.setattr(density, "tree_edges", lambda own: fitted.append(own.count()) or real(own))
    n = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    found = registry.queries()[name](spark, FOLDER)
    assert fitted == [n] and "% 5" not in registry.oracle_sql()[name]
    if name == "spanning_tree":
        assert found.count() == n - 1
    if name == "condensed_tree":
        assert found.where("cluster = parent").first()["size"] == n
