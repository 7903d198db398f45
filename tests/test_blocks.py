"""Blocks of distinct cell vectors: packing, walking trees, the same sums in any order of rows."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskweave.operators import blocks
from riskweave.operators.boosting import NewtonBoosting


def test_blocks_hold_every_vector_in_one_order(spark):
    rng = np.random.default_rng(1)
    cells = np.unique(rng.integers(0, 30, (5000, 3)), axis=0).astype(np.int32)
    rows = [(c.tobytes(), int(k)) for k, c in enumerate(cells)]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "cells binary, n bigint").repartition(5)
        held, _, n = blocks.stored_blocks(df, [30] * 3, {"n": np.int64}, block_rows=700)
        assert n == len(cells) and held.count() < 40  # rows hold blocks, not vectors
        got.append(sorted((bytes(r.cells), bytes(r.n)) for r in held.collect()))
    assert got[0] == got[1]
    found = {}
    for c, n in got[0]:
        found |= dict(zip(np.frombuffer(n, np.int64).tolist(), map(tuple, np.frombuffer(c, np.uint16).reshape(3, -1).T.tolist())))
    assert found == {k: tuple(c) for k, c in enumerate(cells.tolist())}


def test_places_follow_the_tree():
    left, right = np.array([1, -1, 3, -1, 5, -1, -1]), np.array([2, -1, 4, -1, 6, -1, -1])
    feature, cell = np.array([0, 0, 1, 0, 0, 0, 0]), np.array([3, 0, 2, 0, 7, 0, 0])
    cells = np.random.default_rng(2).integers(0, 10, (2, 300)).astype(np.uint16)
    want = [1 if a <= 3 else 3 if b <= 2 else 5 if a <= 7 else 6 for a, b in cells.T]
    assert blocks.places(cells, left, right, feature, cell).tolist() == want
    assert not blocks.places(cells, np.array([-1]), np.array([-1]), np.array([0]), np.array([0])).any()


def test_boosting_is_the_same_to_the_bit_in_any_order(spark):
    x = F.array((F.rand(1) * 40).cast("int").cast("double"), (F.rand(2) * 30).cast("int").cast("double"))
    df = spark.range(4000).select(array_to_vector(x).alias("features"), (F.rand(3) < 0.2 + F.rand(2) / 2).cast("int").alias("label")).localCheckpoint()
    grown = [NewtonBoosting(max_iter=3, max_depth=4, task_rows=60).fit(d).nodes.orderBy("tree", "id").collect() for d in (df, df.repartition(7))]
    assert grown[0] == grown[1] and len(grown[0]) > 40
