"""Gaussian kernel density of a value per class, each class normalised alone.

Bandwidth h = sample std * n^(-1/5) (Scott's rule in one dimension), grid
of 200 points over [min - 3h, max + 3h].

Plan: one aggregate gives each class its size, bandwidth and grid, which
are joined to the rows (the optimizer broadcasts them if they are small).
Each task adds the kernels of its rows to one array of grid sums per class,
batch by batch in numpy (equal values of a batch count once), and yields
the arrays once; Spark adds them per class. So nothing larger than classes
x grid leaves a task, whether the column is discrete or continuous. A class
with a single value or zero spread has no bandwidth and so no curve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schema import KDE_CUT, KDE_GRID_POINTS

# Values of one step (times the grid: doubles held), classes that a task holds before it yields.
STEP_VALUES, HELD_CLASSES = 2048, 4096


def kde(df: DataFrame, value: str = "tenure_days", by: str = "default_flag",
        grid_points: int = KDE_GRID_POINTS, cut: float = KDE_CUT) -> DataFrame:
    """Columns: by, grid_index, x, density. No rows unless both columns are there."""
    if not {value, by} <= set(df.columns):
        return df.sparkSession.createDataFrame([], f"`{by}` double, grid_index int, x double, density double")
    d = df.select(F.col(by).alias("class"), F.col(value).cast("double").alias("x")) \
        .where(F.col("class").isNotNull() & F.col("x").isNotNull())
    st = (d.groupBy("class")
          .agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
               F.min("x").alias("mn"), F.max("x").alias("mx"))
          .withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
          .where(F.col("h").isNotNull() & (F.col("h") > 0))
          .withColumn("start", F.col("mn") - cut * F.col("h"))
          .withColumn("width", F.col("mx") - F.col("mn") + 2 * cut * F.col("h")))
    rows = d.join(st.select("class", "h", "start", "width"), "class")
    out_type = T.StructType([T.StructField("class", d.schema["class"].dataType), T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["class", "sums"])
            sums.clear()
            return done

        kind = None
        for b in batches:
            classes = b.column("class").dictionary_encode()
            kind, place = classes.type.value_type, classes.indices.to_numpy()
            x, h, start, width = (b.column(c).to_numpy() for c in ("x", "h", "start", "width"))
            for k, name in enumerate(classes.dictionary.to_pylist()):
                mine = np.flatnonzero(place == k)
                if not len(mine):
                    continue
                first = mine[0]
                grid = start[first] + np.arange(grid_points) * width[first] / (grid_points - 1)
                values, times = np.unique(x[mine], return_counts=True)
                total = sums.setdefault(name, np.zeros(grid_points))
                for lo in range(0, len(values), STEP_VALUES):
                    z = (grid[:, None] - values[None, lo:lo + STEP_VALUES]) / h[first]
                    total += np.exp(-0.5 * z * z) @ times[lo:lo + STEP_VALUES]
            if len(sums) >= HELD_CLASSES:
                yield flush()
        if sums:
            yield flush()

    merged = rows.mapInArrow(run, out_type).groupBy("class").agg(F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(grid_points)]).alias("sums"))
    points = st.join(merged, "class").select("class", "n", "h", "start", "width", F.posexplode("sums").alias("grid_index", "ksum"))
    return points.select(F.col("class").alias(by), "grid_index", (F.col("start") + F.col("grid_index") * F.col("width") / float(grid_points - 1)).alias("x"),
                         (F.col("ksum") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density")).orderBy(by, "grid_index")
