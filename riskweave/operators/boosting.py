"""Boosted trees by second-order (Newton) steps with an L2 term on the leaves.

Round by round a tree is fitted to the gradients g and Hessians h of the
logistic loss. A node with sums G and H has the value -G / (H + lambda), and
the best split maximises

    GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

over features and cell bounds, both sides holding at least
``min_child_weight`` of Hessian.

Rows become vectors of cells (``riskweave.operators.forest``), and equal
vectors count once with their number and their number of ones, so that the
work of a round follows the distinct vectors. They are held in blocks
(``riskweave.operators.blocks``). A tree takes one job per level: each task
adds up one histogram of G and H per open node and feature over its blocks,
Spark brings the parts of a histogram together, and its best split is found
there; the driver sees one row per open node and feature. The running
margins are written every few rounds, so lineage and the work of a task stay
short.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import blocks
from riskweave.operators.explain import NODES, with_cells
from riskweave.operators.forest import BINS, TreeModel, cell_bounds
from riskweave.session import scratch_path

# Rounds after which the margins are written.
KEPT_ROUNDS = 4
# A split must gain more than this.
LEAST_GAIN = 1e-6

NUMBERS = {"n": np.int64, "ones": np.int64, "margin": np.float64}
STATE = "cells binary, n binary, ones binary, margin binary"
PARTS = "slot int, feature int, part int, sums binary"
SPLITS = "slot int, feature int, gain double, cell int, total array<double>, below array<double>"


@dataclass
class Grown:
    """One tree: nodes as lists; a leaf has left -1."""
    left: list[int]
    right: list[int]
    feature: list[int]
    cell: list[int]
    g: list[float]
    h: list[float]
    value: np.ndarray | None = None

    @classmethod
    def root(cls) -> Grown:
        return cls([-1], [-1], [0], [0], [0.0], [0.0])

    def split(self, node: int, feature: int, cell: int, total: np.ndarray, below: np.ndarray) -> tuple[int, int]:
        """Give ``node`` two children, of the sums (G, H, ...) ``below`` and the rest."""
        left = len(self.left)
        self.left[node], self.right[node], self.feature[node], self.cell[node] = left, left + 1, feature, cell
        self.left += [-1, -1]
        self.right += [-1, -1]
        self.feature += [0, 0]
        self.cell += [0, 0]
        self.g += [below[0], total[0] - below[0]]
        self.h += [below[1], total[1] - below[1]]
        return left, left + 1

    def places(self, cells: np.ndarray) -> np.ndarray:
        """Node that each vector of ``cells`` (features x vectors) is in."""
        return blocks.places(cells, *(np.array(x) for x in (self.left, self.right, self.feature, self.cell)))


def histograms(cells: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, slots: int, most: int) -> np.ndarray:
    """[slots, features, G / H, cells]: the sums over the vectors of each slot."""
    out = np.zeros((slots, len(cells), 2, most))
    for f, mine in enumerate(cells):
        key = slot * most + mine
        for k, w in enumerate((g, h)):
            out[:, f, k] = np.bincount(key, w, slots * most).reshape(slots, most)
    return out


def best_split(sums: np.ndarray, reg: float, least: float) -> tuple[float, int, np.ndarray, np.ndarray]:
    """(gain, cell, total, below) of the best bound of one histogram (G, H, ...
    x cells), the first of equal ones; gain -inf without an allowed one."""
    total, below = sums.sum(1), np.cumsum(sums, 1)[:, :-1]
    above = total[:, None] - below
    gain = np.full(below.shape[1], -np.inf)
    ok = (below[1] >= least) & (above[1] >= least)
    gain[ok] = below[0, ok] ** 2 / (below[1, ok] + reg) + above[0, ok] ** 2 / (above[1, ok] + reg) - total[0] ** 2 / (total[1] + reg)
    if not ok.any():
        return -math.inf, 0, total, np.zeros(len(sums))
    k = int(gain.argmax())
    return float(gain[k]), k, total, below[:, k]


@dataclass
class NewtonBoosting:
    max_iter: int = 100
    max_depth: int = 6
    step_size: float = 0.3
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    bins: int = BINS
    task_rows: int = blocks.BLOCK_ROWS  # distinct vectors of a block
    features: str = "features"
    label: str = "label"

    def fit(self, train: DataFrame) -> TreeModel:
        """Boost on ``train`` (vector column without missing values, 0/1 label)."""
        spark = train.sparkSession
        x = train.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("label"))
        width = x.agg(F.max(F.size("x")).alias("w")).first()["w"]
        bounds = cell_bounds(x, width, self.bins)
        counts = with_cells(x, bounds).groupBy("cells").agg(F.count("*").alias("n"), F.sum("label").cast("bigint").alias("ones"))
        sizes = [len(bounds[f]) + 1 for f in range(width)]
        state, path, _ = blocks.stored_blocks(counts.select("*", F.lit(0.0).alias("margin")), sizes, NUMBERS, self.task_rows)
        total = x.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
        share = total["ones"] / total["n"]
        base = math.log(share / (1 - share))
        trees: list[Grown] = []
        pending: list[Grown] = []
        for _ in range(self.max_iter):
            tree = self._tree(state, base, pending, sizes)
            trees.append(tree)
            pending.append(tree)
            if len(pending) == KEPT_ROUNDS:
                after, fresh = self._stored(self._moved(state, pending, sizes))
                self._delete(spark, path)
                state, path, pending = after, fresh, []
        self._delete(spark, path)
        nodes = scratch_path(spark, "boosted")
        # The model itself: at most max_iter * 2 ** (max_depth + 1) nodes.
        spark.createDataFrame(self._nodes(trees, bounds, base, float(total["n"])), NODES).write.parquet(nodes)
        return TreeModel(spark, nodes, f"newton-{uuid.uuid4().hex}", "log_odds")

    @staticmethod
    def _stored(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(df.sparkSession, "margins")
        df.write.parquet(path)
        return df.sparkSession.read.schema(STATE).parquet(path), path

    @staticmethod
    def _delete(spark, path: str) -> None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    @staticmethod
    def _moved(state: DataFrame, pending: list[Grown], sizes: list[int]) -> DataFrame:
        """``state`` with the pending trees added to the margins."""
        width, kind = len(sizes), blocks.cell_type(sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cells, n, ones, margin in blocks.unpacked(batches, width, kind, NUMBERS):
                margin = margin + sum(t.value[t.places(cells)] for t in pending)
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (cells, n, ones, margin)], ["cells", *NUMBERS])

        return state.mapInArrow(run, STATE)

    def _tree(self, state: DataFrame, base: float, pending: list[Grown], sizes: list[int]) -> Grown:
        tree, open_ = Grown.root(), [0]
        for _ in range(self.max_depth):
            if not open_:
                break
            best: dict[int, tuple] = {}
            for r in self._splits(state, base, pending, tree, open_, sizes).collect():
                mine = (-r["gain"], r["feature"], r["cell"], r["total"], r["below"])
                best[open_[r["slot"]]] = min(best.get(open_[r["slot"]], mine), mine)
            open_ = []
            for node, (gain, feature, cell, total, below) in sorted(best.items()):
                tree.g[node], tree.h[node] = total
                if -gain > LEAST_GAIN:
                    open_ += tree.split(node, feature, cell, np.array(total), np.array(below))
        tree.value = -np.array(tree.g) / (np.array(tree.h) + self.reg_lambda) * self.step_size
        return tree

    def _splits(self, state: DataFrame, base: float, pending: list[Grown], tree: Grown, open_: list[int], sizes: list[int]) -> DataFrame:
        """Best split of every open node by every feature, from the sums over all rows."""
        width, most, kind, reg, least = len(sizes), max(sizes), blocks.cell_type(sizes), self.reg_lambda, self.min_child_weight
        slot_of = np.full(len(tree.left), -1)
        slot_of[open_] = np.arange(len(open_))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(open_), width, 2, most))
            for cells, n, ones, margin in blocks.unpacked(batches, width, kind, NUMBERS):
                p = 1 / (1 + np.exp(-sum((t.value[t.places(cells)] for t in pending), base + margin)))
                g, h, slot = n * p - ones, n * p * (1 - p), slot_of[tree.places(cells)]
                some = np.flatnonzero(slot >= 0)
                if len(some) < len(slot):
                    cells, slot, g, h = cells[:, some], slot[some], g[some], h[some]
                sums += histograms(cells, slot, g, h, len(open_), most)
            s, f = np.nonzero(sums[:, :, 1].any(2))
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(f, pa.int32()), pa.array(np.full(len(s), TaskContext.get().partitionId()), pa.int32()),
                                              pa.array([sums[i, j].tobytes() for i, j in zip(s, f)], pa.binary())], ["slot", "feature", "part", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for s, f, raw in zip(*(b.column(c).to_pylist() for c in ("slot", "feature", "sums"))):
                    part = np.frombuffer(raw).reshape(2, most)
                    held[s, f] = held[s, f] + part if (s, f) in held else part
            rows = [(s, f, *best_split(part[:, :sizes[f]], reg, least)) for (s, f), part in held.items()]
            if rows:
                types = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["slot", "feature", "gain", "cell", "total", "below"])

        tasks = max(1, min(len(open_) * width // 8, state.sparkSession.sparkContext.defaultParallelism))
        # The parts of a sum are added in one order, whatever the order of arrival.
        return state.mapInArrow(count, PARTS).repartition(tasks, "slot", "feature").sortWithinPartitions("part").mapInArrow(merge, SPLITS)

    @staticmethod
    def _nodes(trees: list[Grown], bounds: dict[int, np.ndarray], base: float, rows: float) -> list[tuple]:
        """Rows of the node table; the first tree is the base margin alone. Covers are Hessian sums."""
        out = [(0, 0, -1, -1, None, None, rows, base)]
        for t, tree in enumerate(trees, 1):
            for k in range(len(tree.left)):
                inner = tree.left[k] >= 0
                out.append((t, k, tree.left[k], tree.right[k], tree.feature[k] if inner else None,
                            float(bounds[tree.feature[k]][tree.cell[k]]) if inner else None, float(tree.h[k]), 0.0 if inner else float(tree.value[k])))
        return out
