"""Forest growing: splits against exhaustive search, unlimited depth, the distributed fit."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import explain
from riskweave.operators.forest import LocalForest, best_splits, grow, poisson


def exhaustive(cells, weight, positive):
    best = (-np.inf,)
    for f in range(cells.shape[1]):
        for c in np.unique(cells[:, f])[:-1]:
            left = cells[:, f] <= c
            s = sum((positive[m].sum() ** 2 + (weight[m].sum() - positive[m].sum()) ** 2) / weight[m].sum() for m in (left, ~left))
            best = max(best, (s, -f, -c))
    return best


def test_best_splits_equal_exhaustive_search():
    rng = np.random.default_rng(1)
    cells, node = rng.integers(0, 6, (300, 4)).astype(np.int32), rng.integers(0, 9, 300)
    cells[node == 3] = 2  # nothing to split
    weight, label = rng.integers(1, 4, 300).astype(float), rng.integers(0, 2, 300)
    score, feature, cell = best_splits(cells, node, weight, weight * label, np.ones((9, 4), bool))
    for k in range(9):
        want = exhaustive(cells[node == k], weight[node == k], (weight * label)[node == k])
        assert score[k] == pytest.approx(want[0])
        if k != 3:
            left = cells[node == k][:, feature[k]] <= cell[k]
            w, p = weight[node == k], (weight * label)[node == k]
            assert sum((p[m].sum() ** 2 + (w[m].sum() - p[m].sum()) ** 2) / w[m].sum() for m in (left, ~left)) == pytest.approx(want[0])


def value(tree, row):
    at = 0
    while tree["left"][at] >= 0:
        at = tree["left"][at] if row[tree["feature"][at]] <= tree["cell"][at] else tree["right"][at]
    return tree["ones"][at] / tree["cover"][at]


def test_grown_until_pure_or_equal():
    rng = np.random.default_rng(2)
    cells, label = rng.integers(0, 40, (400, 5)).astype(np.int32), rng.integers(0, 2, 400)
    cells[:20], label[:10], label[10:20] = 7, 0, 1  # equal rows of both labels
    tree = grow(cells, label, np.ones(400), rng, np.inf)
    inner = tree["left"] >= 0
    assert (tree["cover"][tree["left"][inner]] + tree["cover"][tree["right"][inner]] == tree["cover"][inner]).all()
    for k in range(20, 400):
        assert value(tree, cells[k]) == label[k] or (cells[k] == 7).all()
    assert value(tree, cells[0]) == 0.5


def test_deeper_than_thirty_and_depth_limit():
    cells, label = np.arange(48, dtype=np.int32)[:, None], np.zeros(48, np.int64)
    weight = 2.0 ** np.arange(48, 0, -1)  # the heaviest rows are split off each time
    label[::2] = 1

    def depth(tree):
        out = np.zeros(len(tree["left"]), int)
        for k in np.flatnonzero(tree["left"] >= 0):
            out[[tree["left"][k], tree["right"][k]]] = out[k] + 1
        return out.max()

    assert depth(grow(cells, label, weight, np.random.default_rng(1), np.inf)) > 30
    assert depth(grow(cells, label, weight, np.random.default_rng(1), 3)) == 3
    assert depth(grow(cells, label, weight, np.random.default_rng(1), 0)) == 0


def test_poisson_draws():
    seeds = np.random.default_rng(3).integers(-2 ** 63, 2 ** 63 - 1, 200_000)
    for mean in (1.0, 7.5, 200.0):
        d = poisson(np.full(len(seeds), mean), seeds)
        assert d.mean() == pytest.approx(mean, rel=0.02) and d.var() == pytest.approx(mean, rel=0.05)
    assert (poisson(np.ones(9), seeds[:9]) == poisson(np.ones(9), seeds[:9])).all()


@pytest.fixture(scope="module")
def train(spark):
    x = F.array((F.rand(1) * 50).cast("int").cast("double"), F.rand(2), (F.rand(3) * 3).cast("int").cast("double"), F.lit(1.0))
    df = spark.range(3000).select(F.col("id").alias("loan_no"), x.alias("x"))
    label = ((F.col("x")[0] + 10 * F.col("x")[2] > 30) | (F.col("x")[1] > 0.9)).cast("int")
    df = df.withColumn("label", label).select("loan_no", array_to_vector("x").alias("features"), "label")
    return df


def test_fit_scores_and_is_repeatable(spark, train):
    grown = [LocalForest(num_trees=8, task_rows=200).fit(d) for d in (train, train.repartition(7).orderBy(F.desc("loan_no")))]
    nodes = [sorted((r.tree, r.id, r.left, r.right, r.feature or 0, r.threshold or 0.0, round(r.value, 9)) for r in g.nodes.collect() if r.id >= 1 << 32) for g in grown]
    assert len(nodes[0]) > 100 and len({r[0] for r in nodes[0]}) == 8
    scored = grown[0].scored(train, "features", "pd")
    assert scored.columns == ["loan_no", "label", "pd"] and scored.count() == train.count()
    r = scored.agg(F.avg(((F.col("pd") > 0.5).cast("int") == F.col("label")).cast("double")).alias("acc"), F.min("pd").alias("lo"), F.max("pd").alias("hi")).first()
    assert r.acc > 0.97 and 0 <= r.lo < 0.1 and 0.9 < r.hi <= 1 + 1e-9
    # every path of every tree is whole, and attributions add up to the scores
    held = {(n.tree, n.id): n for n in grown[0].nodes.collect()}
    children = [(n.tree, c) for n in held.values() if n.left >= 0 for c in (n.left, n.right)]
    assert len(set(children)) == len(children) and set(children) <= set(held) and len(held) - len(children) == 8
    phi = explain.shap_values(grown[0], train.limit(300), ["a", "b", "c", "d"]).groupBy("loan_no").agg(F.sum("phi").alias("phi"))
    base = explain.base_value(grown[0].nodes)
    worst = phi.join(scored, "loan_no").agg(F.max(F.abs(F.col("phi") + base - F.col("pd")))).first()[0]
    assert worst < 1e-9


def test_depth_limit_of_a_fit(spark, train):
    nodes = LocalForest(num_trees=3, max_depth=3).fit(train).nodes.collect()
    assert max(sum(1 for n in nodes if n.tree == t) for t in range(3)) <= 15
