"""Newton boosting against a plain version on a small table."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators.boosting import NewtonBoosting, best_split


def plain(x, y, rounds, depth, rate=0.3, reg=1.0, least=1.0):
    """Margins after ``rounds`` trees grown by exhaustive search over all values."""
    share = y.mean()
    margin = np.full(len(y), math.log(share / (1 - share)))

    def grow(rows, g, h, level):
        value = -g[rows].sum() / (h[rows].sum() + reg) * rate
        best = (1e-6, None)
        if level < depth:
            for f in range(x.shape[1]):
                for t in np.unique(x[rows, f])[:-1]:
                    left = x[rows, f] <= t
                    hl, hr = h[rows][left].sum(), h[rows][~left].sum()
                    if hl >= least and hr >= least:
                        gl, gr = g[rows][left].sum(), g[rows][~left].sum()
                        gain = gl ** 2 / (hl + reg) + gr ** 2 / (hr + reg) - (gl + gr) ** 2 / (hl + hr + reg)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, t))
        if best[1] is None:
            margin[rows] += value
            return
        f, t = best[1]
        grow(rows[x[rows, f] <= t], g, h, level + 1)
        grow(rows[x[rows, f] > t], g, h, level + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grow(np.arange(len(y)), p - y, p * (1 - p), 0)
    return margin


def test_best_split_equals_all_bounds():
    rng = np.random.default_rng(1)
    g, h = rng.normal(size=40), rng.random(40)
    sums = np.stack([g, h, np.ones(40)])
    gain, k, total, below = best_split(sums, 1.0, 1.0)
    every = [(g[:i].sum() ** 2 / (h[:i].sum() + 1) + g[i:].sum() ** 2 / (h[i:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1), -(i - 1))
             for i in range(1, 40) if h[:i].sum() >= 1 and h[i:].sum() >= 1]
    assert (gain, -k) == (pytest.approx(max(every)[0]), max(every)[1])
    np.testing.assert_allclose(below, sums[:, :k + 1].sum(1))
    np.testing.assert_allclose(total, sums.sum(1))
    assert best_split(np.ones((3, 1)), 1.0, 0.1)[0] == -math.inf and best_split(sums, 1.0, 100.0)[0] == -math.inf


@pytest.mark.parametrize("task_rows, rounds", [(10 ** 6, 12), (100, 3), (1, 2)])  # finished in tasks, half and half, by levels
def test_margins_equal_a_plain_version(spark, task_rows, rounds):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (600, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 8) ^ (rng.random(600) < 0.15)).astype(int)
    df = spark.createDataFrame([(k, r.tolist(), int(v)) for k, (r, v) in enumerate(zip(x, y))], "loan_no bigint, x array<double>, label int") \
        .select("loan_no", array_to_vector("x").alias("features"), "label").repartition(3)
    model = NewtonBoosting(max_iter=rounds, max_depth=3, task_rows=task_rows).fit(df)
    got = {r["loan_no"]: r["pd"] for r in model.scored(df, "features", "pd").collect()}
    want = 1 / (1 + np.exp(-plain(x, y, rounds, 3)))
    np.testing.assert_allclose([got[k] for k in range(600)], want, atol=1e-9)
    assert model.nodes.where("left < 0").count() > 4 * rounds and model.kind == "log_odds"
