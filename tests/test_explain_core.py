"""TreeSHAP core against brute-force Shapley values (no Spark needed)."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from riskweave.operators import explain
from riskweave.operators.explain import cells_of, ensemble_score, ensemble_shap, leaf_paths, tree_of


def leaf(i, v, n):
    return {"id": i, "prediction": v, "impurityStats": [n], "leftChild": -1, "rightChild": -1,
            "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}


def node(i, f, t, l, r, n):
    return {"id": i, "prediction": 0.0, "impurityStats": [n], "leftChild": l, "rightChild": r,
            "split": {"featureIndex": f, "leftCategoriesOrThreshold": [t], "numCategories": -1}}


def sample_tree():
    # feature 0 used twice on one path, feature 2 never used
    return {n["id"]: n for n in [
        node(0, 0, 0.5, 1, 2, 100.0),
        node(1, 1, 1.5, 3, 4, 60.0),
        node(2, 0, 2.5, 5, 6, 40.0),
        leaf(3, 1.0, 25.0), node(4, 0, -1.0, 7, 8, 35.0),
        leaf(5, -2.0, 30.0), leaf(6, 4.0, 10.0),
        leaf(7, 0.5, 5.0), leaf(8, 3.0, 30.0),
    ]}


def exp_value(nodes, x, S, nid=0):
    """Path-dependent conditional expectation E[f | x_S] (TreeSHAP, Algorithm 1)."""
    n = nodes[nid]
    if n["leftChild"] < 0:
        return n["prediction"]
    f, t = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
    if f in S:
        return exp_value(nodes, x, S, n["leftChild"] if x[f] <= t else n["rightChild"])
    c = n["impurityStats"][0]
    l, r = nodes[n["leftChild"]], nodes[n["rightChild"]]
    return (l["impurityStats"][0] / c * exp_value(nodes, x, S, l["id"])
            + r["impurityStats"][0] / c * exp_value(nodes, x, S, r["id"]))


def brute_shap(nodes, x, m):
    phi = np.zeros(m)
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        for s in range(m):
            for S in combinations(rest, s):
                w = factorial(s) * factorial(m - s - 1) / factorial(m)
                phi[i] += w * (exp_value(nodes, x, set(S) | {i}) - exp_value(nodes, x, set(S)))
    return phi


def thresholds_of(trees):
    out = {}
    for nodes in trees:
        for n in nodes.values():
            if n["leftChild"] >= 0:
                out.setdefault(n["split"]["featureIndex"], set()).add(n["split"]["leftCategoriesOrThreshold"][0])
    return {f: np.array(sorted(out[f])) for f in sorted(out)}


def as_tree(nodes, thresholds):
    columns = {"id": [], "left": [], "right": [], "feature": [], "threshold": [], "cover": [], "value": []}
    for n in nodes.values():
        split = n["split"]
        for c, v in zip(columns, (n["id"], n["leftChild"], n["rightChild"], split["featureIndex"],
                                  (split["leftCategoriesOrThreshold"] or [0.0])[0], n["impurityStats"][0], n["prediction"])):
            columns[c].append(v)
    return tree_of({c: np.array(v) for c, v in columns.items()}, thresholds)


def shap(trees, x):
    """Attributions of the features that are split on."""
    thresholds = thresholds_of(trees)
    return ensemble_shap(cells_of(x, thresholds), iter([as_tree(t, thresholds) for t in trees]))


@pytest.mark.parametrize("x", [[0.0, 1.0, 9.0], [-2.0, 3.0, 0.0], [1.0, 0.0, 0.0], [3.0, 2.0, 1.0],
                               [0.5, 1.5, 0.0], [-1.0, 9.0, 5.0]])
def test_matches_brute_force(x):
    nodes = sample_tree()
    phi = shap([nodes], np.array([x]))[0]
    np.testing.assert_allclose(phi, brute_shap(nodes, x, 3)[:2], atol=1e-12)
    # additivity: base + sum(phi) = prediction
    assert exp_value(nodes, x, set()) + phi.sum() == pytest.approx(exp_value(nodes, x, {0, 1, 2}))


def random_tree(rng, features, depth, values=None):
    nodes, count = {}, [0]

    def grow(level, n):
        i = count[0]
        count[0] += 1
        if level == depth or n < 2 or rng.random() < 0.1:
            nodes[i] = leaf(i, float(rng.choice(values) if values else rng.normal()), float(n))
            return i
        nodes[i] = None
        share = int(rng.integers(1, n))
        f, t = int(rng.integers(features)), float(rng.integers(-3, 4))
        nodes[i] = node(i, f, t, grow(level + 1, share), grow(level + 1, n - share), float(n))
        return i

    grow(0, 1000)
    return nodes


@pytest.mark.parametrize("depth, features", [(2, 2), (4, 3), (6, 5), (9, 6)])
def test_random_ensembles_match_brute_force(depth, features, monkeypatch):
    rng = np.random.default_rng(depth)
    trees = [random_tree(rng, features, depth) for _ in range(3)]
    used = list(thresholds_of(trees))
    x = rng.integers(-4, 5, (25, features)).astype(float)
    want = np.array([sum(brute_shap(t, r, features) for t in trees) for r in x])[:, used]
    np.testing.assert_allclose(shap(trees, x), want, atol=1e-10)
    monkeypatch.setattr(explain, "TABLE_BITS", 1)      # patterns that occur instead of all
    np.testing.assert_allclose(shap(trees, x), want, atol=1e-10)
    monkeypatch.setattr(explain, "STEP_ELEMENTS", 1)   # one leaf at a time
    np.testing.assert_allclose(shap(trees, x), want, atol=1e-10)


def test_deep_tree_of_many_features_adds_up():
    rng = np.random.default_rng(8)
    tree = random_tree(rng, 40, 24)
    x = rng.integers(-4, 5, (30, 40)).astype(float)
    phi = shap([tree], x).sum(1)
    want = [exp_value(tree, r, set(range(40))) - exp_value(tree, r, set()) for r in x]
    np.testing.assert_allclose(phi, want, atol=1e-9)


def test_scores_are_leaf_values():
    rng = np.random.default_rng(9)
    trees = [random_tree(rng, 4, 7) for _ in range(4)]
    x = np.concatenate([rng.normal(size=(40, 4)) * 3, rng.integers(-3, 4, (40, 4))])
    thresholds = thresholds_of(trees)
    got = ensemble_score(cells_of(x, thresholds), iter([as_tree(t, thresholds) for t in trees]))[:, 0]
    np.testing.assert_allclose(got, [sum(exp_value(t, r, {0, 1, 2, 3}) for t in trees) for r in x])


def test_single_leaf_tree():
    only = {0: leaf(0, 0.7, 10.0)}
    assert shap([only], np.zeros((4, 2))).sum() == 0
    assert ensemble_score(cells_of(np.zeros((4, 2)), {}), iter([as_tree(only, {})])).tolist() == [[0.7]] * 4


def test_most_common_leaf_value_is_dropped():
    rng = np.random.default_rng(5)
    tree = random_tree(rng, 3, 6, values=[0.0, 0.25, 1.0])
    thresholds = thresholds_of([tree])
    grown = as_tree(tree, thresholds)
    kept = leaf_paths(grown, len(thresholds))
    assert 0 < len(kept.value) < (grown.left < 0).sum() and (kept.value != 0).all()
    for x in rng.normal(size=(20, 3)) * 3:
        np.testing.assert_allclose(shap([tree], np.array([x]))[0], brute_shap(tree, x, 3)[list(thresholds)], atol=1e-12)
