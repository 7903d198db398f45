"""The forest over blocks: no node above the limit goes to a task; trees packed and cells dealt by context."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import explain
from riskweave.operators.forest import LocalForest


@pytest.fixture(scope="module")
def skewed(spark):
    """Noise: its best splits cut off the ends, so that nodes stay large for many levels."""
    x = F.array((F.rand(5) * 300).cast("int").cast("double"), (F.rand(6) * 20).cast("int").cast("double"))
    return spark.range(4000).select(F.col("id").alias("loan_no"), array_to_vector(x).alias("features"), (F.rand(7) < 0.03).cast("int").alias("label")).localCheckpoint()


def test_every_node_grown_by_a_task_is_small(spark, skewed, monkeypatch):
    seen = {}
    lower = LocalForest._lower
    monkeypatch.setattr(LocalForest, "_lower", lambda self, state, tops, *rest: seen.update(tops) or lower(self, state, tops, *rest))
    model = LocalForest(num_trees=4, task_rows=150).fit(skewed)
    assert len(seen) == 4
    for top in seen.values():
        assert top.lower and max(top.held[k] for k in top.lower) <= 150
        for k in range(len(top.left)):
            if top.left[k] >= 0:
                assert top.cover[k] == top.cover[top.left[k]] + top.cover[top.right[k]]
    held = {(n.tree, n.id): n for n in model.nodes.collect()}
    children = [(n.tree, c) for n in held.values() if n.left >= 0 for c in (n.left, n.right)]
    assert len(set(children)) == len(children) and set(children) <= set(held) and len(held) - len(children) == 4
    for n in held.values():  # one bootstrap sample above and below
        if n.left >= 0:
            assert n.cover == held[n.tree, n.left].cover + held[n.tree, n.right].cover


def test_a_tree_is_one_packed_row_and_blocks_do_not_change_attributions(spark, skewed, monkeypatch):
    model = LocalForest(num_trees=3, max_depth=6).fit(skewed)
    thresholds = explain.threshold_table(model.nodes)
    packed = explain.packed_trees(model.nodes, thresholds).collect()
    assert sorted(r.tree for r in packed) == [0, 1, 2]
    assert sum(len(r.left) // 4 for r in packed) == model.nodes.count()

    def phi():
        return [(r.loan_no, r.feature, round(r.phi, 10)) for r in explain.shap_values(model, skewed.limit(500), ["a", "b"]).orderBy("loan_no", "feature").collect()]

    one = phi()
    monkeypatch.setattr(explain, "BLOCK_CELLS", 40)
    monkeypatch.setattr(explain, "KEPT_STARTS", 1)
    assert phi() == one and len(one) == 1000
