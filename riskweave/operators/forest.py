"""Random forest whose trees are finished in tasks: no depth limit, no nodes on the driver.

1. Every row becomes its vector of cells (up to BINS value ranges per
   feature); equal vectors count once, with their numbers of zeros and ones,
   and are held in blocks (``riskweave.operators.blocks``).
2. A tree draws a bootstrap weight per vector and label (Poisson with its
   count as mean, from a hash of tree and vector: the same in every pass).
3. Nodes of more than ``task_rows`` vectors are split by one job per level
   for all trees: every task adds up histograms over its blocks, Spark brings
   the parts together, the driver sees one split per node.
4. The vectors of each smaller node go to one task, as blocks, which grows
   the subtree below it, all its nodes of a level at once in numpy: Gini
   impurity, ceil(sqrt(features)) random features per split and more while
   they give none, until nodes are pure or their vectors equal in all
   features (or ``max_depth`` is reached).

The result is a node table in Parquet, which scoring and attributions read.
The driver holds the nodes above ``task_rows``, the cell bounds and nothing
that grows with the rows of a node.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators import blocks
from riskweave.operators.explain import NODES, score_nodes, with_cells
from riskweave.session import scratch_path

BINS = 256
# Distinct vectors of a node that one task grows the subtree of.
TASK_ROWS = 1 << 20
# Levels after which a node is grown by one task however many vectors it still has.
MOST_UPPER = 48
# Ids: 0 is the root, ID_SPACE + k the upper node k, (k + 1) * ID_SPACE + i the
# i-th node grown below the upper node (or root) k.
ID_SPACE = 1 << 32

NUMBERS = {"zeros": np.int64, "ones": np.int64, "hash": np.int64}
PARTS = "tree int, slot int, part int, sums binary"
SPLITS = "tree int, slot int, feature int, cell int, total array<double>, below array<double>"
DEALT = "task int, tree int, node bigint, cells binary, weight binary, ones binary"


def cell_bounds(rows: DataFrame, width: int, bins: int = BINS) -> dict[int, np.ndarray]:
    """Up to ``bins`` - 1 thresholds per feature of the array column ``x``,
    from one sketch of its quantiles; the largest value bounds nothing."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col("x")[f], at, F.lit(20 * bins)).alias(f"q{f}") for f in range(width)],
                     *[F.max(F.col("x")[f]).alias(f"m{f}") for f in range(width)]).first()
    return {f: np.unique([q for q in found[f"q{f}"] or [] if q < found[f"m{f}"]]) for f in range(width)}


def poisson(mean: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """One Poisson draw per row from its own seed, by inversion; large means
    by their normal approximation."""
    h = seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
    out, term, total = np.zeros(len(u)), np.exp(-np.minimum(mean, 50.0)), np.zeros(len(u))
    total += term
    left = u > total
    while left.any():
        out[left] += 1
        term = np.where(left, term * mean / np.maximum(out, 1), term)
        total = np.where(left, total + term, total)
        left &= (u > total) & (mean <= 50) & (out < 400)
    large = mean > 50
    if large.any():
        v = (((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        out[large] = np.maximum(0, np.rint(mean + np.sqrt(mean) * z))[large]
    return out


def drawn(zeros: np.ndarray, ones: np.ndarray, hashed: np.ndarray, seed: int, tree: int) -> tuple[np.ndarray, np.ndarray]:
    """Bootstrap weights (all, of label 1) of vectors in a tree."""
    w0, w1 = (poisson(n.astype(np.float64), hashed ^ np.int64((seed * 1_000_003 + 2 * tree + k) * 2_654_435_761 % (1 << 63))) for k, n in enumerate((zeros, ones)))
    return w0 + w1, w1


def gini(below_w: np.ndarray, below_p: np.ndarray, above_w: np.ndarray, above_p: np.ndarray) -> np.ndarray:
    """The sum over both sides of the squared class weights over the side's weight."""
    return (below_p * below_p + (below_w - below_p) ** 2) / below_w + (above_p * above_p + (above_w - above_p) ** 2) / above_w


def best_splits(cells: np.ndarray, node: np.ndarray, weight: np.ndarray, positive: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, feature, cell) of the best split of every node over the features
    that ``wanted`` (nodes x features) marks: the sum over both sides of the
    squared class weights over the side's weight, -inf without a split."""
    return splits_by_feature(np.ascontiguousarray(cells.T), node, weight, positive, wanted)


def splits_by_feature(cells: np.ndarray, node: np.ndarray, weight: np.ndarray, positive: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``best_splits`` of cells as features x vectors."""
    score = np.full(len(wanted), -np.inf)
    feature, cell = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    for f in range(len(cells)):
        rows = np.flatnonzero(wanted[:, f][node])
        if not len(rows):
            continue
        most = int(cells[f].max()) + 1
        key = node[rows].astype(np.int64) * most + cells[f][rows]
        if len(wanted) * most <= 4 * len(rows):  # few nodes: one place per (node, cell)
            w = np.bincount(key, weight[rows], len(wanted) * most)
            p = np.bincount(key, positive[rows], len(wanted) * most)
            key = np.flatnonzero(w)
            w, p = np.cumsum(w[key]), np.cumsum(p[key])
        else:
            bits = int(len(rows)).bit_length()
            if int(len(wanted) * most).bit_length() + bits < 63:  # key and place sorted as one number
                packed = np.sort(key << bits | np.arange(len(rows)))
                key, rows = packed >> bits, rows[packed & ((1 << bits) - 1)]
            else:
                order = np.argsort(key, kind="stable")
                key, rows = key[order], rows[order]
            last = np.flatnonzero(np.append(key[1:] != key[:-1], True))  # the last row of each (node, cell)
            key, w, p = key[last], np.cumsum(weight[rows])[last], np.cumsum(positive[rows])[last]
        own = key // most
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        size = np.diff(np.append(first, len(own)))
        end = first + size - 1
        inner = np.ones(len(own), bool)
        inner[end] = False
        inner = np.flatnonzero(inner)
        if not len(inner):
            continue
        group = np.repeat(np.arange(len(first)), size - 1)
        before_w, before_p = (np.concatenate([[0.0], c])[first] for c in (w, p))
        lw, lp = w[inner] - before_w[group], p[inner] - before_p[group]
        s = gini(lw, lp, (w[end] - before_w)[group] - lw, (p[end] - before_p)[group] - lp)
        start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        top = np.maximum.reduceat(s, start)
        best = np.flatnonzero(s == np.repeat(top, np.diff(np.append(start, len(s)))))
        best = best[np.append(True, group[best][1:] != group[best][:-1])]
        mine = own[inner[best]]
        better = s[best] > score[mine]
        best, mine = best[better], mine[better]
        score[mine], feature[mine], cell[mine] = s[best], f, key[inner[best]] - mine * most
    return score, feature, cell


def node_id(number: int) -> int:
    """The id of an upper node."""
    return ID_SPACE + number if number else 0


def tried_features(features: int) -> int:
    return max(1, math.ceil(math.sqrt(features)))


def grow(cells: np.ndarray, label: np.ndarray, weight: np.ndarray, rng: np.random.Generator, max_depth: float) -> dict[str, np.ndarray]:
    """Nodes of one tree: left (-1: leaf), right, feature, cell, cover and the
    weight of label 1 (``ones``); node 0 is the root."""
    return grow_by_feature(np.ascontiguousarray(cells.T), weight, weight * label, rng, max_depth)


def grow_by_feature(cells: np.ndarray, weight: np.ndarray, positive: np.ndarray, rng: np.random.Generator, max_depth: float) -> dict[str, np.ndarray]:
    """``grow`` of cells as features x vectors, ``positive`` of whose weight is of label 1."""
    features = len(cells)
    tried = tried_features(features)
    columns = {"left": [np.array([-1])], "right": [np.array([-1])], "feature": [np.array([0])], "cell": [np.array([0])],
               "cover": [np.array([weight.sum()])], "ones": [np.array([positive.sum()])]}
    total, depth = 1, 0
    place, active = np.zeros(len(weight), np.int64), np.array([0])  # of the vectors in nodes that may split
    while depth < max_depth and len(place):
        cover, ones = columns["cover"][-1], columns["ones"][-1]
        mixed = (ones > 0) & (ones < cover)
        kept = np.flatnonzero(mixed[place])
        if len(kept) < len(place):
            cells, weight, positive, place = cells[:, kept], weight[kept], positive[kept], place[kept]
        if not len(place):
            break
        order = rng.random((len(active), features))
        chosen = order <= np.partition(order, tried - 1, 1)[:, tried - 1:tried]
        score, feature, cell = splits_by_feature(cells, place, weight, positive, chosen & mixed[:, None])
        lost = mixed & np.isinf(score)  # none of the features tried differs between the rows: look at the others
        if lost.any() and tried < features:
            s, f, c = splits_by_feature(cells, place, weight, positive, ~chosen & lost[:, None])
            score, feature, cell = np.where(lost, s, score), np.where(lost, f, feature), np.where(lost, c, cell)
        split = np.flatnonzero(~np.isinf(score))
        if not len(split):
            break
        number = np.full(len(active), -1)
        number[split] = np.arange(len(split))
        left = total + 2 * np.arange(len(split))
        flat = {k: np.concatenate(v) for k, v in columns.items() if k not in ("cover", "ones")}
        at = active[split]
        flat["left"][at], flat["right"][at] = left, left + 1
        flat["feature"][at], flat["cell"][at] = feature[split], cell[split]
        columns |= {k: [v] for k, v in flat.items()}
        node = number[place]
        kept = np.flatnonzero(node >= 0)
        if len(kept) < len(node):
            cells, weight, positive, node = cells[:, kept], weight[kept], positive[kept], node[kept]
        own = np.ravel(cells).take(feature[split].take(node) * len(node) + np.arange(len(node)))
        place = 2 * node + (own > cell[split].take(node))
        active = np.stack([left, left + 1], 1).ravel()
        for k, v in (("left", -1), ("right", -1), ("feature", 0), ("cell", 0)):
            columns[k].append(np.full(len(active), v))
        columns["cover"].append(np.bincount(place, weight, len(active)))
        columns["ones"].append(np.bincount(place, positive, len(active)))
        total, depth = total + len(active), depth + 1
    return {k: np.concatenate(v) for k, v in columns.items()}


@dataclass
class Top:
    """The nodes of one tree above those that tasks grow, as lists; a leaf has
    left -1. ``large`` are to be split yet, ``lower`` to be grown by a task."""
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    feature: list[int] = field(default_factory=lambda: [0])
    cell: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    cover: list[float] = field(default_factory=lambda: [0.0])
    ones: list[float] = field(default_factory=lambda: [0.0])
    held: list[float] = field(default_factory=lambda: [0.0])
    large: list[int] = field(default_factory=list)
    lower: list[int] = field(default_factory=list)

    def split(self, node: int, feature: int, cell: int, total: list[float], below: list[float]) -> list[int]:
        """The two new children of ``node``, of the sums (weight, weight of label 1, vectors) ``below`` and the rest."""
        left = len(self.left)
        self.left[node], self.right[node], self.feature[node], self.cell[node] = left, left + 1, feature, cell
        for sums in (below, [t - b for t, b in zip(total, below)]):
            for column, value in zip((self.left, self.right, self.feature, self.cell, self.depth), (-1, -1, 0, 0, self.depth[node] + 1)):
                column.append(value)
            for column, value in zip((self.cover, self.ones, self.held), sums):
                column.append(value)
        return [left, left + 1]

    def places(self, cells: np.ndarray) -> np.ndarray:
        return blocks.places(cells, *(np.array(x) for x in (self.left, self.right, self.feature, self.cell)))


@dataclass
class TreeModel:
    """A fitted ensemble: its node table at ``path``, and what the summed leaf
    values are: the 'probability' of class 1 or its 'log_odds'."""
    spark: object
    path: str
    uid: str
    kind: str

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODES).parquet(self.path).drop("part")

    def scored(self, prepared: DataFrame, features: str, name: str) -> DataFrame:
        """``prepared`` with the probability of class 1 as ``name``."""
        scored = score_nodes(self.nodes, prepared, features, name)
        return scored if self.kind == "probability" else scored.withColumn(name, 1 / (1 + F.exp(-F.col(name))))


@dataclass
class LocalForest:
    num_trees: int = 100
    max_depth: int | None = None
    seed: int = 42
    bins: int = BINS
    task_rows: int = TASK_ROWS
    features: str = "features"
    label: str = "label"

    def fit(self, train: DataFrame) -> TreeModel:
        """Grow the forest on ``train`` (vector column and 0/1 label)."""
        spark = train.sparkSession
        x = train.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("label"))
        width = x.agg(F.max(F.size("x")).alias("width")).first()["width"]
        bounds = cell_bounds(x, width, self.bins)
        sizes = [len(bounds[f]) + 1 for f in range(width)]
        counts = with_cells(x, bounds).groupBy("cells").agg(F.sum(1 - F.col("label")).cast("bigint").alias("zeros"), F.sum("label").cast("bigint").alias("ones"))
        state, _, rows = blocks.stored_blocks(counts.withColumn("hash", F.xxhash64("cells")), sizes, NUMBERS)
        tops = self._upper(state, rows, sizes)
        grown = scratch_path(spark, "forest")
        self._lower(state, tops, bounds, sizes).write.parquet(f"{grown}/part=lower")
        begun = {r["tree"] for r in spark.read.schema(NODES).parquet(f"{grown}/part=lower").where("id = 0").select("tree").collect()}
        upper = []
        for t, top in tops.items():
            lower = {k for k in top.lower if k or t in begun}
            for k in range(len(top.left)):
                if k in lower:
                    continue
                inner, cover = top.left[k] >= 0, top.cover[k] or 1.0  # a tree that drew no row says nothing
                upper.append((t, node_id(k), *(node_id(c) if inner else -1 for c in (top.left[k], top.right[k])), top.feature[k] if inner else None,
                              float(bounds[top.feature[k]][top.cell[k]]) if inner else None, float(cover), 0.0 if inner else float(top.ones[k] / cover / self.num_trees)))
        spark.createDataFrame(upper, NODES).write.parquet(f"{grown}/part=upper")
        return TreeModel(spark, grown, f"forest-{uuid.uuid4().hex}", "probability")

    def _upper(self, state: DataFrame, rows: int, sizes: list[int]) -> dict[int, Top]:
        """The trees down to nodes of at most ``task_rows`` vectors."""
        deepest = math.inf if self.max_depth is None else self.max_depth
        tops = {t: Top() for t in range(self.num_trees)}

        def sort_in(top: Top, node: int) -> None:
            mixed = 0 < top.ones[node] < top.cover[node]
            if node and (not mixed or top.depth[node] >= deepest):
                return  # a leaf
            large = top.held[node] > self.task_rows and top.depth[node] < min(MOST_UPPER, deepest)
            (top.large if large else top.lower).append(node)

        for top in tops.values():
            top.held[0] = rows  # at most
            sort_in(top, 0)
        while any(top.large for top in tops.values()):
            found = self._splits(state, tops, sizes).collect()
            asked = {t: top.large for t, top in tops.items()}
            for top in tops.values():
                top.large = []
            for r in sorted(found, key=lambda r: (r["tree"], r["slot"])):
                top, node = tops[r["tree"]], asked[r["tree"]][r["slot"]]
                top.cover[node], top.ones[node], top.held[node] = r["total"]
                if r["feature"] >= 0:
                    for child in top.split(node, r["feature"], r["cell"], r["total"], r["below"]):
                        sort_in(top, child)
        return tops

    def _splits(self, state: DataFrame, tops: dict[int, Top], sizes: list[int]) -> DataFrame:
        """The split of every large node, from histograms over all vectors; feature -1: none."""
        width, most, kind, seed = len(sizes), max(sizes), blocks.cell_type(sizes), self.seed
        asked = {t: top for t, top in tops.items() if top.large}
        tried = tried_features(width)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(blocks.unpacked(batches, width, kind, NUMBERS))
            for t, top in asked.items():
                slots = len(top.large)
                slot_of = np.full(len(top.left), -1)
                slot_of[top.large] = np.arange(slots)
                sums = np.zeros((slots, width, 3, most))
                for cells, zeros, ones, hashed in held:
                    weight, positive = drawn(zeros, ones, hashed, seed, t)
                    slot = np.where(weight > 0, slot_of[top.places(cells)], -1)
                    some = np.flatnonzero(slot >= 0)
                    for f in range(width):
                        key = slot[some] * most + cells[f][some]
                        for k, w in enumerate((weight, positive, None)):
                            sums[:, f, k] += np.bincount(key, None if w is None else w[some], slots * most).reshape(slots, most)
                for s in np.flatnonzero(sums[:, 0, 2].any(1)).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (t, s, TaskContext.get().partitionId())] + [pa.array([sums[s].tobytes()], pa.binary())],
                                                     ["tree", "slot", "part", "sums"])

        def split(tree: int, slot: int, sums: np.ndarray) -> tuple:
            total = sums[0].sum(1)
            order = np.random.default_rng([seed, tree, asked[tree].large[slot]]).permutation(width)
            best = (-np.inf, -1, 0, np.zeros(3))
            for k, f in enumerate(order.tolist()):
                if k >= tried and best[1] >= 0:
                    break
                below = np.cumsum(sums[f], 1)[:, :-1]
                inner = np.flatnonzero((sums[f, 2, :-1] > 0) & (below[2] < total[2]))
                if len(inner):
                    (w, p, _), at = below[:, inner], inner
                    score = gini(w, p, total[0] - w, total[1] - p)
                    i = int(score.argmax())
                    best = max(best, (float(score[i]), f, int(at[i]), below[:, at[i]]), key=lambda x: x[0])
            return tree, slot, best[1], best[2], total.tolist(), best[3].tolist()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                for i in range(b.num_rows):
                    key, part = (b.column("tree")[i].as_py(), b.column("slot")[i].as_py()), np.frombuffer(b.column("sums")[i].as_buffer()).reshape(width, 3, most)
                    held[key] = held[key] + part if key in held else part
            for (t, s), sums in held.items():
                types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([c], y) for c, y in zip(split(t, s, sums), types)], ["tree", "slot", "feature", "cell", "total", "below"])

        tasks = min(sum(len(top.large) for top in asked.values()), 4 * state.sparkSession.sparkContext.defaultParallelism)
        return state.mapInArrow(count, PARTS).repartition(tasks, "tree", "slot").mapInArrow(merge, SPLITS)

    def _lower(self, state: DataFrame, tops: dict[int, Top], bounds: dict[int, np.ndarray], sizes: list[int]) -> DataFrame:
        """Nodes grown below the lower nodes; the first of each is that node."""
        width, kind, seed, trees = len(sizes), blocks.cell_type(sizes), self.seed, self.num_trees
        deepest = math.inf if self.max_depth is None else self.max_depth
        # The largest nodes first, dealt to the tasks in turn.
        order = sorted(((top.held[k], t, k) for t, top in tops.items() for k in top.lower), reverse=True)
        tasks = max(1, min(len(order), 1000))
        task_of = {(t, k): i % tasks for i, (_, t, k) in enumerate(order)}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cells, zeros, ones, hashed in blocks.unpacked(batches, width, kind, NUMBERS):
                for t, top in tops.items():
                    if not top.lower:
                        continue
                    weight, positive = drawn(zeros, ones, hashed, seed, t)
                    wanted = np.zeros(len(top.left), bool)
                    wanted[top.lower] = True
                    at = top.places(cells)
                    some = np.flatnonzero((weight > 0) & wanted[at])
                    some = some[np.argsort(at[some], kind="stable")]
                    for mine in np.split(some, np.flatnonzero(np.diff(at[some])) + 1):
                        if len(mine):
                            node = int(at[mine[0]])
                            packed = (np.ascontiguousarray(cells[:, mine]), weight[mine], positive[mine])
                            yield pa.RecordBatch.from_arrays([pa.array([task_of[t, node]], pa.int32()), pa.array([t], pa.int32()), pa.array([node], pa.int64()),
                                                              *(pa.array([c.tobytes()], pa.binary()) for c in packed)], ["task", "tree", "node", "cells", "weight", "ones"])

        def finish(t: int, node: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
            cells = np.concatenate([np.frombuffer(c, kind).reshape(width, -1) for c, _, _ in held], 1)
            weight, positive = (np.concatenate([np.frombuffer(h[k]) for h in held]) for k in (1, 2))
            # Weights are whole numbers: the same vectors in any order give the same subtree.
            found = grow_by_feature(cells, weight, positive, np.random.default_rng([seed, t, node]), deepest - tops[t].depth[node])
            n = len(found["left"])
            ids = np.where(np.arange(n) == 0, node_id(node), (node + 1) * ID_SPACE + np.arange(n))
            inner = found["left"] >= 0
            threshold = np.full(n, np.nan)
            for f in range(width):
                mine = np.flatnonzero(inner & (found["feature"] == f))
                if len(mine):
                    threshold[mine] = np.asarray(bounds[f], np.float64)[found["cell"][mine]]
            children = [np.where(inner, (node + 1) * ID_SPACE + found[c], -1) for c in ("left", "right")]
            arrays = [pa.array(np.full(n, t, np.int32)), pa.array(ids), *(pa.array(c) for c in children), pa.array(found["feature"].astype(np.int32), mask=~inner),
                      pa.array(threshold, mask=~inner), pa.array(found["cover"]), pa.array(np.where(inner, 0.0, found["ones"] / found["cover"] / trees))]
            whole = pa.RecordBatch.from_arrays(arrays, ["tree", "id", "left", "right", "feature", "threshold", "cover", "value"])
            for lo in range(0, n, 1 << 16):
                yield whole.slice(lo, 1 << 16)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, last = [], None
            for b in batches:
                for i in range(b.num_rows):
                    now = b.column("tree")[i].as_py(), b.column("node")[i].as_py()
                    if held and now != last:
                        yield from finish(*last, held)
                        held = []
                    last = now
                    held.append(tuple(b.column(c)[i].as_py() for c in ("cells", "weight", "ones")))
            if held:
                yield from finish(*last, held)

        return state.mapInArrow(deal, DEALT).repartitionById(tasks, "task").sortWithinPartitions("tree", "node").mapInArrow(run, NODES)
