"""Attributions over grids: a leaf costs the groups of cell vectors, not the vectors; groups, pieces and halved grids."""

import time

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import explain
from riskweave.operators.forest import LocalForest, grow
from tests.test_explain_core import as_tree, brute_shap, random_tree, thresholds_of


def grown_tree(sizes, rows, seed):
    """A full tree over random cells and labels."""
    rng = np.random.default_rng(seed)
    cells = np.column_stack([rng.integers(0, n, rows) for n in sizes])
    n = grow(cells, rng.integers(0, 2, rows), np.ones(rows), rng, 30)
    return explain.Tree(n["left"], n["right"], n["feature"], n["cell"], n["cover"], n["ones"] / n["cover"], 0)


def test_a_leaf_does_not_cost_the_contexts():
    """Twelve times the contexts (distinct vectors without the feature of most cells) are no twelve times the time."""
    tree = grown_tree((60, 40, 30), 20000, 3)
    every = np.stack(np.meshgrid(range(60), range(40), range(30), indexing="ij"), -1).reshape(-1, 3).astype(np.int32)

    def seconds(cells):
        found = []
        for _ in range(2):
            t = time.process_time()
            explain.ensemble_shap(cells, iter([tree] * 6))
            found.append(time.process_time() - t)
        return min(found)

    small = every[(every[:, 1] < 10) & (every[:, 2] < 10)]
    seconds(small)
    assert len(every) == 12 * len(small) and seconds(every) < 3 * seconds(small)


@pytest.mark.parametrize("grid", [[0], [1, 0], [3, 1, 2], [0, 1, 2, 3, 4]])
@pytest.mark.parametrize("most", [1, 200, 1 << 23])
def test_every_grid_gives_the_same_attributions(grid, most, monkeypatch):
    monkeypatch.setattr(explain, "KEPT_STARTS", most)  # groups halved to single cells, to some, not at all
    rng = np.random.default_rng(11)
    trees = [random_tree(rng, 5, 7) for _ in range(3)]
    thresholds = thresholds_of(trees)
    x = rng.integers(-4, 5, (40, 5)).astype(float)
    want = np.array([sum(brute_shap(t, r, 5) for t in trees) for r in x])[:, list(thresholds)]
    got = explain.ensemble_shap(explain.cells_of(x, thresholds), iter([as_tree(t, thresholds) for t in trees]), grid)
    np.testing.assert_allclose(got, want, atol=1e-10)


def test_groups_hold_every_vector_once_and_fit():
    rng = np.random.default_rng(2)
    cells = np.unique(np.column_stack([rng.integers(0, n, 4000) for n in (50, 30, 3, 2)]).astype(np.int32), axis=0)
    grid = explain.gridded(cells)
    assert 0 in grid and 1 in grid
    groups = explain.groups_of(cells, grid, 6)
    assert sorted(np.concatenate([g.rows for g in groups]).tolist()) == list(range(len(cells)))
    rest = [f for f in range(4) if f not in grid]
    assert all((cells[g.rows][:, rest] == g.own[rest]).all() for g in groups)
    numbers = explain.block_numbers(cells, 1 << 20, grid)
    assert len({tuple(c) for c in cells[:, rest].tolist()}) == len(np.unique(numbers))
    pieces = explain.block_numbers(cells, 1 << 20, grid, 5, 50)
    assert len(np.unique(pieces)) > len(np.unique(numbers)) and 0 <= numbers.min() and pieces.max() < 1 << 20


def test_blocks_by_group_and_by_piece_give_the_same_attributions(spark, monkeypatch):
    x = F.array((F.rand(5) * 300).cast("int").cast("double"), (F.rand(6) * 20).cast("int").cast("double"), (F.rand(8) * 2).cast("int").cast("double"))
    rows = spark.range(3000).select(F.col("id").alias("loan_no"), array_to_vector(x).alias("features"), (F.rand(7) < 0.3).cast("int").alias("label")).localCheckpoint()
    model = LocalForest(num_trees=3, max_depth=7).fit(rows)

    def phi():
        return [(r.loan_no, r.feature, round(r.phi, 10)) for r in explain.shap_values(model, rows.limit(600), ["a", "b", "c"]).orderBy("loan_no", "feature").collect()]

    one = phi()
    monkeypatch.setattr(explain, "BLOCK_CELLS", 30)
    monkeypatch.setattr(explain, "GRID_VECTORS", 20)
    assert phi() == one and len(one) == 1800
