"""Summary statistics, correlation matrix and box statistics.

* ``describe_long``: one aggregate for count/mean/std/min/max of all
  columns, plus exact quartiles from :mod:`riskweave.functions.quantiles`
  on the unpivoted (column, value) pairs; one row per column.
* ``corr_long``: Pearson with pairwise deletion from masked Gramians that
  each task adds up over its Arrow batches, summed per pair by Spark; a
  constant column gives NULL.
* ``box_stats``: exact quartiles per group, then one more pass with the
  broadcast (tiny) quartile table for the whisker ends and outlier count.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.quantiles import exact_quantiles
from riskweave.schema import CORR_EXCLUDE, STANDARD_COLUMNS, SUMMARY_EXCLUDE, is_numeric

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns by schema (no job), minus ``exclude``."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def macro_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not standard loan columns (layered variables)."""
    return numeric_columns(df, STANDARD_COLUMNS)


def describe_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, 25/50/75% (linear), max per numeric column.

    One group-by on the (column, value) pairs for the moments, joined with
    the exact quartiles of the same pairs; lazy, one row per column.
    """
    cols = list(columns) if columns is not None else numeric_columns(df, SUMMARY_EXCLUDE)
    spark = df.sparkSession
    schema = ("variable string, count bigint, mean double, std double, "
              "min double, p25 double, p50 double, p75 double, max double")
    if not cols:
        return spark.createDataFrame([], schema)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv")) \
        .select("kv.variable", "kv.value")
    moments = (long.groupBy("variable")
               .agg(F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                    F.min("value").alias("min"), F.max("value").alias("max")))
    quartiles = exact_quantiles(long, "value", QUARTILES, by=["variable"]).select(
        F.col("variable").alias("__v"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"))
    every = spark.createDataFrame([(c,) for c in cols], "__c string")
    out = every.join(moments, F.col("__c") == F.col("variable"), "left").join(quartiles, F.col("__c") == F.col("__v"), "left")
    return out.select(F.col("__c").alias("variable"), F.coalesce("count", F.lit(0)).alias("count"),
                      "mean", "std", "min", "p25", "p50", "p75", "max")


def _clamp(r):
    """A correlation lies in [-1, 1]; rounding can step just outside. NULL stays NULL."""
    return F.when(r > 1.0, F.lit(1.0)).when(r < -1.0, F.lit(-1.0)).otherwise(r)


def corr_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Full correlation matrix in long form (col_a, col_b, corr); needs two columns."""
    cols = list(columns) if columns is not None else numeric_columns(df, CORR_EXCLUDE)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    return _corr_gram(df, cols)


_GRAM_FIELDS = ("n", "sa", "sb", "saa", "sbb", "sab", "min_a", "max_a", "min_b", "max_b")


def _corr_gram(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pairwise-deletion Pearson correlation from per-task masked Gramians.

    Each task adds up over its batches and gives, for every pair (a <= b), the count of rows where
    both are set and the sums of x_a, x_b, x_a^2, x_b^2, x_a*x_b over those
    rows (matrix products of the centred values and the presence mask),
    plus the least and greatest x_a and x_b there. Spark sums these
    partials per pair (map-side combined, k^2 groups). Values are centred by
    the column means (one small aggregate first) so the sums do not cancel;
    a pair whose column is constant on the shared rows, or with fewer than
    two shared rows, gives NULL, as the guarded aggregate does.
    """
    import numpy as np
    import pandas as pd

    spark = df.sparkSession
    k = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([means[f"m{i}"] if means[f"m{i}"] is not None else 0.0 for i in range(k)])
    ia, ib = np.triu_indices(k)

    def partials(batches):
        total = {f: np.zeros((k, k)) for f in ("n", "sx", "sxx", "sxy")}
        lo, hi = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for pdf in batches:
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan)
            m = ~np.isnan(x)
            mf = m.astype(np.float64)
            xc = np.where(m, x - shift, 0.0)
            total["n"] += mf.T @ mf
            total["sx"] += xc.T @ mf             # [a, b]: sum of x_a where b is set
            total["sxx"] += (xc * xc).T @ mf
            total["sxy"] += xc.T @ xc
            for b in range(k):
                both = m & m[:, b:b + 1]
                lo[:, b] = np.minimum(lo[:, b], np.where(both, x, np.inf).min(axis=0, initial=np.inf))
                hi[:, b] = np.maximum(hi[:, b], np.where(both, x, -np.inf).max(axis=0, initial=-np.inf))
        n, sx, sxx, sxy = total.values()
        yield pd.DataFrame({
            "a": ia.astype(np.int32), "b": ib.astype(np.int32), "n": n[ia, ib],
            "sa": sx[ia, ib], "sb": sx[ib, ia], "saa": sxx[ia, ib], "sbb": sxx[ib, ia], "sab": sxy[ia, ib],
            "min_a": lo[ia, ib], "max_a": hi[ia, ib], "min_b": lo[ib, ia], "max_b": hi[ib, ia]})

    out_schema = "a int, b int, " + ", ".join(f"{f} double" for f in _GRAM_FIELDS)
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    sums = (src.mapInPandas(partials, out_schema).groupBy("a", "b")
            .agg(*[F.sum(f).alias(f) for f in _GRAM_FIELDS[:6]],
                 F.min("min_a").alias("min_a"), F.max("max_a").alias("max_a"),
                 F.min("min_b").alias("min_b"), F.max("max_b").alias("max_b")))
    n = F.when(F.col("n") > 0, F.col("n"))
    cov = F.col("sab") - F.col("sa") * F.col("sb") / n
    va = F.col("saa") - F.col("sa") * F.col("sa") / n
    vb = F.col("sbb") - F.col("sb") * F.col("sb") / n
    defined = (n >= 2) & (F.col("min_a") < F.col("max_a")) & (F.col("min_b") < F.col("max_b")) & (va > 0) & (vb > 0)
    r = sums.select("a", "b", _clamp(F.when(defined, cov / F.sqrt(va * vb))).alias("corr"))
    # Every pair appears, also pairs with no shared row (bounded: k^2 rows).
    names = [(i, c) for i, c in enumerate(cols)]
    grid = spark.createDataFrame([(i, j, ci, cj) for i, ci in names for j, cj in names if i <= j],
                                 "a int, b int, col_a string, col_b string")
    full = grid.join(r, ["a", "b"], "left")
    upper = full.select("col_a", "col_b", "corr")
    lower = full.where(F.col("a") != F.col("b")).select(F.col("col_b").alias("col_a"),
                                                         F.col("col_a").alias("col_b"), "corr")
    return upper.unionByName(lower)


def box_stats(df: DataFrame, value: str, by: str = "default_flag") -> DataFrame:
    """Quartiles, 1.5 IQR whisker ends (last value inside the fence) and outlier
    count per group. No rows unless both columns are there."""
    if not {value, by} <= set(df.columns):
        return df.sparkSession.createDataFrame([], f"`{by}` double, n bigint, q1 double, median double, q3 double, "
                                                   "whisker_lo double, whisker_hi double, n_outliers bigint")
    d = df.select(F.col(by), F.col(value).cast("double").alias("v")) \
        .where(F.col(by).isNotNull() & F.col("v").isNotNull())
    q = exact_quantiles(d, "v", QUARTILES, by=[by]).select(
        by, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    j = d.join(q, by)
    return (j.groupBy(by, "n", "q1", "median", "q3")
            .agg(F.min(F.when(F.col("v") >= F.col("lo_fence"), F.col("v"))).alias("whisker_lo"),
                 F.max(F.when(F.col("v") <= F.col("hi_fence"), F.col("v"))).alias("whisker_hi"),
                 F.count_if((F.col("v") < F.col("lo_fence")) | (F.col("v") > F.col("hi_fence")))
                  .alias("n_outliers"))
            .orderBy(by))
