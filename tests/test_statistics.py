import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.functions.quantiles import exact_quantiles
from riskweave.operators import density, statistics


def test_exact_quantiles_small_groups(spark):
    rng = np.random.default_rng(1)
    vals = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 500), rng.normal(size=500))]
    df = spark.createDataFrame(vals + [(1, None)], "g int, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", [0.25, 0.5, 0.75], by=["g"]).collect()}
    for g in range(3):
        x = np.array([v for k, v in vals if k == g])
        assert got[g].n == len(x)
        np.testing.assert_allclose([got[g].q0, got[g].q1, got[g].q2], np.percentile(x, [25, 50, 75]), rtol=1e-12)


def test_exact_quantiles_bracket_path(spark):
    # a coarse sketch leaves wide brackets in every group, including
    # heavy ties and a hot group holding most rows.
    rng = np.random.default_rng(2)
    g = np.where(rng.random(20000) < 0.8, 0, 1)
    v = np.round(rng.exponential(size=20000) * 10, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, v)], "g int, v double")
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "v", probs, by=["g"], accuracy=200).collect()}
    for k in (0, 1):
        expect = np.percentile(v[g == k], [p * 100 for p in probs])
        np.testing.assert_allclose([got[k][f"q{i}"] for i in range(len(probs))], expect, rtol=1e-12)


def test_median_averages_middle_pair(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 100)], "v double")
    r = exact_quantiles(df, "v", [0.5]).first()
    assert r.q0 == 2.5 and r.n == 4


def test_corr_guarded(spark):
    rows = [(1.0, 2.0, 5.0, 1.0), (2.0, 4.1, 5.0, None), (3.0, 6.3, 5.0, 1.0), (4.0, None, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r.col_a, r.col_b): r.corr for r in statistics.corr_long(df).collect()}
    assert len(got) == 16
    assert got[("a", "c")] is None and got[("c", "c")] is None           # constant column
    a = np.array([1.0, 2.0, 3.0]); b = np.array([2.0, 4.1, 6.3])         # pairwise deletion
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert got[("b", "a")] == got[("a", "b")]
    assert got[("b", "d")] is None                                       # constant after deletion
    assert statistics.corr_long(df.select("a")).count() == 0


def test_corr_equals_numpy_on_wide_frame(spark):
    rng = np.random.default_rng(7)
    n, k = 3000, 12
    base = rng.normal(size=(n, 1))
    x = base * rng.normal(size=(1, k)) + rng.normal(size=(n, k)) * 3 + 1e6  # large offset
    x[rng.random((n, k)) < 0.1] = np.nan
    x[:, 5] = 0.1                                                            # constant column
    x[:1500, 7] = np.nan                                                     # half missing
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(k))).repartition(5)
    a = {(r.col_a, r.col_b): r.corr for r in statistics.corr_long(df).collect()}
    assert len(a) == k * k
    for i in range(k):
        for j in range(k):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 5 in (i, j):
                assert a[(f"x{i}", f"x{j}")] is None
            else:
                assert a[(f"x{i}", f"x{j}")] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    assert a[("x5", "x0")] is None and a[("x0", "x0")] == pytest.approx(1.0)


def test_describe_long(spark):
    x = [1.0, 2.0, 4.0, 8.0, None]
    df = spark.createDataFrame([(v, 7, 1.0) for v in x], "amount double, loan_no int, default_flag double")
    r = statistics.describe_long(df).collect()
    assert [row.variable for row in r] == ["amount"]  # ids and the target are left out
    a = np.array(x[:4])
    row = r[0]
    assert (row["count"], row["min"], row["max"]) == (4, 1.0, 8.0)
    assert row.mean == pytest.approx(a.mean()) and row["std"] == pytest.approx(a.std(ddof=1))
    np.testing.assert_allclose([row.p25, row.p50, row.p75], np.percentile(a, [25, 50, 75]))


def test_box_stats(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 100.0, -50.0]
    df = spark.createDataFrame([(v, 0.0) for v in vals] + [(10.0, 1.0)], "v double, f double")
    got = {r.f: r for r in statistics.box_stats(df, "v", "f").collect()}
    q1, q2, q3 = np.percentile(vals, [25, 50, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    r = got[0.0]
    assert (r.q1, r.median, r.q3) == (q1, q2, q3)
    assert r.whisker_lo == min(v for v in vals if v >= lo) and r.whisker_hi == max(v for v in vals if v <= hi)
    assert r.n_outliers == 2
    assert got[1.0].n_outliers == 0 and got[1.0].whisker_lo == 10.0


def test_kde(spark):
    rng = np.random.default_rng(3)
    x0 = rng.integers(0, 50, 300).astype(float)
    rows = [(float(v), 0.0) for v in x0] + [(5.0, 1.0), (5.0, 1.0)]  # class 1 has no spread: no curve
    df = spark.createDataFrame(rows, "x double, f double")
    out = density.kde(df, "x", "f").collect()
    assert {r.f for r in out} == {0.0} and len(out) == 200
    h = x0.std(ddof=1) * len(x0) ** -0.2
    grid = np.linspace(x0.min() - 3 * h, x0.max() + 3 * h, 200)
    dens = np.exp(-0.5 * ((grid[:, None] - x0[None, :]) / h) ** 2).sum(1) / (len(x0) * h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose([r.x for r in out], grid, rtol=1e-9)
    np.testing.assert_allclose([r.density for r in out], dens, rtol=1e-9)
    assert sum(r.density for r in out) * (grid[1] - grid[0]) == pytest.approx(1.0, abs=0.02)


def test_exact_quantiles_mixed_small_and_large_groups(spark):
    rng = np.random.default_rng(4)
    g = np.where(rng.random(12000) < 0.75, "hot", "cold")
    v = rng.integers(0, 500, 12000).astype(float)
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, v)], "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", [0.25, 0.5, 0.9], by=["g"], accuracy=500).collect()}
    assert set(got) == {"hot", "cold"}
    for k in ("hot", "cold"):
        np.testing.assert_allclose([got[k].q0, got[k].q1, got[k].q2], np.percentile(v[g == k], [25, 50, 90]))
        assert got[k].n == int((g == k).sum())


def test_many_groups(spark):
    df = spark.range(60_003).select((F.col("id") % 20_001).alias("g"), (F.col("id") / 20_001).cast("int").cast("double").alias("v"))
    out = exact_quantiles(df, "v", [0.5], by=["g"])
    assert out.count() == 20_001 and [tuple(r) for r in out.select("n", "q0").distinct().collect()] == [(3, 1.0)]
