"""Per-loan feature attributions (path-dependent TreeSHAP) and scores of tree ensembles.

A row's attribution depends only on which side of each split it lies on.
So the split thresholds of a model form one sorted table per feature, a row
becomes its vector of cells (numbers of thresholds below each value), and
each distinct vector is explained once:

1. rows are mapped to cells; the distinct cells are dealt into large blocks;
2. the node table of the model stays a table: each tree is packed into one
   binary and sent to the blocks, every task takes one block and a share of
   the trees, so that few cells use all cores too; the shares are summed per
   cell;
3. the result is joined back to the rows by their cells.

The driver sees the thresholds (at most bins x features), never nodes.

Algorithm (Lundberg et al., path-dependent TreeSHAP, in product form): a
leaf of value v whose path has the distinct features j, with z_j the share
of training cover that follows the path at its splits on j, and o_j = 1 if
the row's cell lies in the path's interval of j, else 0, adds to feature i

    v (o_i - z_i) integral_0^1 prod_{j != i} (t o_j + (1 - t) z_j) dt

A polynomial in t, which Gauss-Legendre nodes, half as many as features,
integrate exactly. Multiplied out over some features G with many cells (the
gridded ones), it is a sum over the subsets S of G of a number times
prod_{j in S} o_j, and that product marks a box of cells. The other features
only count by their bits o, which are the same for all cells of a group
(vectors equal in all features but those of G). So a leaf is added to a
grid of each group, once at every corner of its boxes (with signs), and
running sums along the axes of the grid give the cells: a leaf costs the
groups and its corners, not the vectors. On an axis where boxes are narrow, it is
added to their cells instead. The grids of a group have the cells that occur
in it only; of the boxes, those without any are left out.

Attributions do not change when all leaf values of a tree move by one
constant, so leaves of the most common value are moved to zero and dropped.

Output scale: boosted trees are explained on the log-odds (Spark's
probability is 1 / (1 + exp(-2 F)), so log-odds = 2 F), random forests on
the class-1 probability. ``base_value`` plus the attributions of a row
equal the model output for that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, fields
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schema import TOP_FEATURES
from riskweave.session import scratch_path

# Distinct cell vectors of a block, about.
BLOCK_CELLS = 1 << 18
# Doubles of the grids of a group, about; a group with larger ones is cut.
KEPT_STARTS = 1 << 23
# Gridded features, at most (their subsets are a table of so many bits).
TABLE_BITS = 10
# Doubles of one step's tables, about; leaves x features that are held at once.
STEP_ELEMENTS = 1 << 20
# Features that may be gridded, and vectors that the choice among them looks at.
GRID_CANDIDATES, GRID_VECTORS = 8, 1 << 16

NODE_COLUMNS = ("id", "left", "right", "feature", "threshold", "cover", "value")
NODE_TYPES = ("bigint", "bigint", "bigint", "int", "double", "double", "double")
NODES = "tree int, " + ", ".join(f"{c} {t}" for c, t in zip(NODE_COLUMNS, NODE_TYPES))


# --- node tables ----------------------------------------------------------------

def node_table(model, spark) -> tuple[DataFrame, str]:
    """(tree, id, left, right, feature, threshold, cover, value) of a fitted
    ensemble, read from its saved form, and the scale of the leaf values
    ('log_odds' or 'probability'); ``left`` is -1 in a leaf."""
    path = scratch_path(spark, "model")
    model.write().overwrite().save(path)
    raw = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    stats = F.col("impurityStats")
    if isinstance(model, GBTClassificationModel):
        weights = F.array(*[F.lit(2.0 * w) for w in model.treeWeights])
        cover, value, kind = stats[0], F.col("prediction") * F.element_at(weights, F.col("treeID") + 1), "log_odds"
    elif isinstance(model, RandomForestClassificationModel):
        cover = F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        value, kind = F.coalesce(F.try_divide(F.get(stats, F.lit(1)), cover), F.lit(0.0)) / model.getNumTrees, "probability"
    else:
        raise TypeError(f"cannot explain {type(model).__name__}")
    # The features of this engine are numbers; a categorical split has no threshold to compare.
    threshold = F.when(F.col("split.numCategories") > 0, F.raise_error(F.lit("categorical splits are not produced by this engine's features")).cast("double")) \
        .otherwise(F.get("split.leftCategoriesOrThreshold", F.lit(0)))
    return raw.select(F.col("treeID").cast("int").alias("tree"), F.col("id").cast("bigint").alias("id"), F.col("leftChild").cast("bigint").alias("left"),
                      F.col("rightChild").cast("bigint").alias("right"), F.col("split.featureIndex").cast("int").alias("feature"),
                      threshold.alias("threshold"), cover.alias("cover"), value.alias("value")), kind


_NODES: dict[tuple[str, int], tuple[DataFrame, str]] = {}


def known_nodes(model, spark) -> tuple[DataFrame, str]:
    """``node_table``, saved once per fitted model, which never changes."""
    key = (model.uid, id(spark.sparkContext))
    if hasattr(model, "nodes"):  # a node table already
        return model.nodes, model.kind
    if key not in _NODES:
        _NODES[key] = node_table(model, spark)
    return _NODES[key]


def base_value(nodes: DataFrame) -> float:
    """The cover-weighted mean leaf value, summed over the trees."""
    root = nodes.groupBy("tree").agg(F.max("cover").alias("all"))
    return float(nodes.where("left < 0").join(root, "tree").agg(F.sum(F.col("value") * F.col("cover") / F.col("all"))).first()[0] or 0.0)


def threshold_table(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Sorted distinct thresholds of every feature that is split on."""
    held: dict[int, list[float]] = {}
    for r in sorted(nodes.where("left >= 0").select("feature", "threshold").distinct().collect()):
        held.setdefault(r["feature"], []).append(r["threshold"])
    return {f: np.array(t) for f, t in held.items()}


# --- kernel ---------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes of one tree; ``feature`` is a place in the cell vector, a row
    goes left if its cell is at most ``cell``."""
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    cell: np.ndarray
    cover: np.ndarray
    value: np.ndarray
    root: int


def tree_of(nodes: dict[str, np.ndarray], thresholds: dict[int, np.ndarray]) -> Tree:
    """The arrays of ``NODE_COLUMNS`` of one tree with node ids turned into
    places and thresholds into cells."""
    order = np.argsort(nodes["id"])
    n = {k: v[order] for k, v in nodes.items()}
    inner = n["left"] >= 0
    at = {f: k for k, f in enumerate(thresholds)}
    feature, cell = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    for f, places in at.items():
        mine = inner & (n["feature"] == f)
        feature[mine], cell[mine] = places, np.searchsorted(thresholds[f], n["threshold"][mine])
    left, right = (np.where(inner, np.searchsorted(n["id"], n[c]), -1) for c in ("left", "right"))
    child = np.zeros(len(order), bool)
    child[left[inner]] = child[right[inner]] = True
    if (n["cover"] <= 0).any():
        raise ValueError("a node without cover has no share of its parent")
    return Tree(left, right, feature, cell, n["cover"], n["value"], int(np.flatnonzero(~child)[0]))


@dataclass
class Leaves:
    """Paths of a tree's leaves: interval of cells [lo, hi) and zero fraction
    per feature, whether the path splits on it, and the leaf values."""
    lo: np.ndarray
    hi: np.ndarray
    zero: np.ndarray
    on: np.ndarray
    value: np.ndarray


def leaf_paths(tree: Tree, width: int) -> Leaves:
    """The leaves whose value is not the tree's most common one, with that
    value taken off; all paths grow level by level."""
    n = len(tree.left)
    lo, hi = np.zeros((n, width), np.int32), np.full((n, width), np.iinfo(np.int32).max, np.int32)
    zero, on = np.ones((n, width)), np.zeros((n, width), bool)
    level = np.array([tree.root])
    while len(level := level[tree.left[level] >= 0]):
        f, cell = tree.feature[level], tree.cell[level] + 1
        for child in (tree.left[level], tree.right[level]):
            lo[child], hi[child], zero[child], on[child] = lo[level], hi[level], zero[level], on[level]
            zero[child, f] *= tree.cover[child] / tree.cover[level]
            on[child, f] = True
        hi[tree.left[level], f] = np.minimum(hi[tree.left[level], f], cell)
        lo[tree.right[level], f] = np.maximum(lo[tree.right[level], f], cell)
        level = np.concatenate([tree.left[level], tree.right[level]])
    leaf = np.flatnonzero(tree.left < 0)
    values, times = np.unique(tree.value[leaf], return_counts=True)
    common = values[times.argmax()]
    leaf = leaf[tree.value[leaf] != common]
    return Leaves(lo[leaf], hi[leaf], zero[leaf], on[leaf], tree.value[leaf] - common)


def hashed(cells: np.ndarray) -> np.ndarray:
    """64 random bits of every cell of every feature (rows x features)."""
    x = cells.astype(np.uint64) + (np.arange(cells.shape[1], dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def gridded(cells: np.ndarray) -> list[int]:
    """The features whose grids make a leaf cheap on vectors like ``cells``:
    from the one of most cells on, the next is the one that lowers groups x
    (corners of a leaf and its share of the running sums) most, if one does.
    Any choice gives the same attributions."""
    bits = hashed(cells)
    every = bits.sum(1)
    numbers = np.array([len(np.unique(c)) for c in cells.T])
    candidates = np.argsort(-numbers, kind="stable")[:GRID_CANDIDATES].tolist()

    def cost(grid: list[int]) -> float:
        rest = every - bits[:, grid].sum(1)
        groups = len(np.unique(rest))
        size = np.prod([len(np.unique(rest + bits[:, j])) / groups + 1 for j in grid]) * (cells.shape[1] - len(grid) + 2)
        corners = np.prod([3 if numbers[j] > 2 else 2 for j in grid])
        return groups * (corners * max(1.0, size / KEPT_STARTS) + size * len(grid) * cells.shape[1] / (2 * STEP_ELEMENTS))

    chosen, best = candidates[:1], cost(candidates[:1])
    while len(chosen) < min(TABLE_BITS, len(candidates)):
        least, j = min((cost([*chosen, j]), j) for j in candidates if j not in chosen)
        if least >= best:
            break
        chosen, best = [*chosen, j], least
    return chosen


@dataclass
class Group:
    """Vectors (``rows`` of a block) with the same cells in all features that
    are not gridded; ``own`` is one of them."""
    rows: np.ndarray
    own: np.ndarray
    shape: list[int]          # cells that occur, per gridded feature, and one after them
    place: list[np.ndarray]   # of each vector on the axis of a gridded feature
    rank: list[np.ndarray]    # of each cell up to the largest of the block and one more: occurring cells below it


def groups_of(cells: np.ndarray, grid: list[int], channels: int) -> list[Group]:
    """The vectors of ``cells`` in groups whose grids of ``channels`` numbers a
    place have at most ``KEPT_STARTS``: larger ones are halved at an axis."""
    rest = np.delete(cells, grid, 1)
    order = np.lexsort(rest.T) if rest.shape[1] else np.arange(len(cells))
    own = rest[order]
    todo = np.split(order, np.flatnonzero((own[1:] != own[:-1]).any(1)) + 1)
    out = []
    while todo:
        rows = todo.pop()
        found = [np.unique(cells[rows, j], return_inverse=True) for j in grid]
        shape = [len(occurs) + 1 for occurs, _ in found]
        longest = int(np.argmax(shape))
        if np.prod(shape, dtype=float) * channels > KEPT_STARTS and shape[longest] > 2:
            low = found[longest][1] < (shape[longest] - 1) // 2
            todo += [rows[low], rows[~low]]
            continue
        rank = [np.searchsorted(occurs, np.arange(int(cells[:, j].max()) + 2)) for j, (occurs, _) in zip(grid, found)]
        out.append(Group(rows, cells[rows[0]], shape, [place.reshape(-1) for _, place in found], rank))
    return out


@dataclass
class Part:
    """Leaves whose paths split on the same number of features besides the
    gridded ones (slots), as slots x leaves and gridded features x leaves."""
    feature: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    zero: np.ndarray
    channel: np.ndarray       # of each slot
    grid_lo: np.ndarray
    grid_hi: np.ndarray
    rest: list[np.ndarray]    # leaf value x zero fractions of the gridded features outside each subset


def subsets_of(grid: list[int]) -> list[list[int]]:
    """The subsets of the places in ``grid``, by the bits of their number."""
    return [[a for a in range(len(grid)) if s >> a & 1] for s in range(1 << len(grid))]


def parts_of(leaves: Leaves, grid: list[int], top: np.ndarray) -> Iterator[Part]:
    """``leaves`` in steps; cells after ``top`` (per gridded feature) occur nowhere."""
    width = leaves.on.shape[1]
    channel_of = np.zeros(width, np.int64)
    others = np.delete(np.arange(width), grid)
    channel_of[others] = 2 + np.arange(len(others))
    other = leaves.on.copy()
    other[:, grid] = False
    slots = other.sum(1)
    for k in np.unique(slots).tolist():
        mine = np.flatnonzero(slots == k)
        step = max(1, STEP_ELEMENTS // (4 * (k + 1) * ((k + len(grid) + 1) // 2 + len(grid) + 1)))
        for at in (mine[i:i + step] for i in range(0, len(mine), step)):
            feature = np.ascontiguousarray(np.nonzero(other[at])[1].reshape(len(at), k).T)
            zero = leaves.zero[at][:, grid].T
            rest = [leaves.value[at] * np.prod([zero[a] for a in range(len(grid)) if a not in s], axis=0) for s in subsets_of(grid)]
            yield Part(feature, leaves.lo[at, feature], leaves.hi[at, feature], leaves.zero[at, feature], channel_of[feature],
                       np.minimum(leaves.lo[at][:, grid].T, top[:, None]), np.minimum(leaves.hi[at][:, grid].T, top[:, None]), rest)


@lru_cache
def unit_legendre(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n Gauss-Legendre nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def narrow_axis(parts: list[Part], group: Group) -> int | None:
    """The axis on which the boxes of ``parts`` hold the fewest occurring cells
    on average, if fewer than two (boxes without any do not count)."""
    means = []
    for a, rank in enumerate(group.rank):
        held = [rank.take(part.grid_hi[a]) - rank.take(part.grid_lo[a]) for part in parts]
        means.append(sum(int(h.sum()) for h in held) / max(1, sum(np.count_nonzero(h) for h in held)))
    least = int(np.argmin(means))
    return least if means[least] < 2 else None


def add_part(grids: list[np.ndarray], part: Part, group: Group, subsets: list[list[int]], narrow: int | None) -> None:
    """Add the leaves of ``part`` to the grids of ``group``, one per subset of
    the gridded features: a box by its corners, on the axis ``narrow`` by its cells.
    Channel 0 counts for the features of the subset, 1 (negative) for the
    other gridded ones, the rest for their own."""
    k, g = len(part.feature), len(group.shape)
    own = group.own[part.feature]
    follows = (own >= part.lo) & (own < part.hi)
    t, w = unit_legendre((k + g + 1) // 2)
    factor = (1 - t)[:, None, None] * part.zero
    factor += t[:, None, None] * follows
    product = factor.prod(1)
    of_grid = np.stack([w * t ** m * (1 - t) ** (g - 1 - m) for m in range(g)]) @ product
    np.divide(product[:, None], factor, out=factor)
    powers = np.stack([w * t ** m * (1 - t) ** (g - m) for m in range(g + 1)])
    of_slots = (powers @ factor.reshape(len(t), -1)).reshape(g + 1, *follows.shape)
    of_slots *= follows - part.zero
    lo, hi = ([r.take(c) for r, c in zip(group.rank, corner)] for corner in (part.grid_lo, part.grid_hi))
    some = [a < b for a, b in zip(lo, hi)]
    flags = [np.ones(len(part.rest[0]), bool)]
    for s, (subset, sums) in enumerate(zip(subsets, grids)):
        if s:  # leaves whose boxes hold an occurring cell on every axis
            last = subset[-1]
            flags.append(flags[s - (1 << last)] & some[last])
        kept = np.flatnonzero(flags[s])
        if not len(kept):
            continue
        n, size = len(subset), sums.shape[1]
        strides = {a: int(np.prod([group.shape[b] for b in subset[i + 1:]], dtype=np.int64)) for i, a in enumerate(subset)}
        start = np.zeros(len(kept), np.int64)
        if narrow in subset:  # a box once per cell
            start = lo[narrow].take(kept)
            times = hi[narrow].take(kept) - start
            if (times > 1).any():
                again = np.repeat(np.arange(len(kept)), times)
                start = start.take(again) + np.arange(len(again)) - (np.cumsum(times) - times).take(again)
                kept = kept.take(again)
            start *= strides[narrow]
        every = len(kept) == len(flags[s]) and flags[s].all()
        mine = (lambda x: x) if every and narrow not in subset else (lambda x: x.take(kept, -1))
        rest = mine(part.rest[s])
        values = (mine(of_slots[n]) * rest).ravel()
        place = mine(part.channel) * size
        index = np.empty_like(place)
        inside = mine(of_grid[n - 1]) * rest if n else None
        outside = mine(of_grid[n]) * rest if n < g else None
        corners = [(start, False)]
        for a in subset:
            if a != narrow:
                begin, end = mine(lo[a]) * strides[a], mine(hi[a]) * strides[a]
                corners = [(at + more, taken != off) for at, taken in corners for more, off in ((begin, False), (end, True))]
        for at, taken in corners:
            put = (np.subtract if taken else np.add).at
            if n:
                put(sums[0], at, inside)
            if n < g:
                put(sums[1], at, outside)
            np.add(place, at, out=index)
            put(sums.reshape(-1), index.ravel(), values)


def add_leaves(out: np.ndarray, leaves: Leaves, grid: list[int], groups: list[Group], top: np.ndarray) -> None:
    """Add the attributions of ``leaves`` to ``out`` (features x vectors)."""
    subsets, parts = subsets_of(grid), list(parts_of(leaves, grid, top))
    others = np.delete(np.arange(len(out)), grid)
    for group in groups:
        grids = [np.zeros((len(others) + 2, int(np.prod([group.shape[a] for a in s], dtype=np.int64)))) for s in subsets]
        narrow = narrow_axis(parts, group)
        for part in parts:
            add_part(grids, part, group, subsets, narrow)
        total = np.zeros((len(out), len(group.rows)))
        for subset, sums in zip(subsets, grids):
            shaped = sums.reshape(-1, *(group.shape[a] for a in subset))
            at = np.zeros(len(group.rows), np.int64)
            for axis, a in enumerate(subset):
                if a != narrow:
                    np.cumsum(shaped, axis + 1, out=shaped)
                at = at * group.shape[a] + group.place[a]
            found = sums.take(at, 1)
            total[others] += found[2:]
            for a, f in enumerate(grid):
                total[f] += found[0] if a in subset else -found[1]
        out[:, group.rows] += total


def ensemble_shap(cells: np.ndarray, trees: Iterator[Tree], grid: Sequence[int] | None = None) -> np.ndarray:
    """Attributions (rows x features) of the rows of ``cells``, summed over
    ``trees``; ``grid`` are the gridded features (by default the best ones)."""
    width = cells.shape[1]
    if not cells.size:
        return np.zeros(cells.shape)
    grid = list(gridded(cells) if grid is None else grid)
    groups, top = groups_of(cells, grid, width - len(grid) + 2), cells[:, grid].max(0) + 1
    out = np.zeros((width, len(cells)))
    held: list[Leaves] = []

    def add() -> None:
        add_leaves(out, Leaves(*(np.concatenate([getattr(x, f.name) for x in held]) for f in fields(Leaves))), grid, groups, top)
        held.clear()

    for tree in trees:
        held.append(leaf_paths(tree, width))
        if sum(x.on.size for x in held) >= STEP_ELEMENTS:
            add()
    if held:
        add()
    return out.T


def ensemble_score(cells: np.ndarray, trees: Iterator[Tree]) -> np.ndarray:
    """(rows x 1): sum of the values of the leaves that each row reaches."""
    total = np.zeros(len(cells))
    for tree in trees:
        at = np.full(len(cells), tree.root)
        while len(open_ := np.flatnonzero(tree.left[at] >= 0)):
            node = at[open_]
            goes_left = cells[open_, tree.feature[node]] <= tree.cell[node]
            at[open_] = np.where(goes_left, tree.left[node], tree.right[node])
        total += tree.value[at]
    return total[:, None]


# --- Spark ----------------------------------------------------------------------

def cells_of(x: np.ndarray, thresholds: dict[int, np.ndarray]) -> np.ndarray:
    """Cell vectors of feature vectors: per feature the number of thresholds
    below the value, so that x <= t[k] exactly if the cell is at most k."""
    return np.stack([np.searchsorted(t, x[:, f]) for f, t in thresholds.items()] or [np.zeros(len(x))], 1).astype(np.int32)


def with_cells(rows: DataFrame, thresholds: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the cell vector of the array column ``x`` as column ``cells``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield b.append_column("cells", pa.array([c.tobytes() for c in cells_of(x, thresholds)], pa.binary()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cells", T.BinaryType())]))


PACKED = "tree int, left binary, right binary, feature binary, cell binary, cover binary, value binary, root bigint"
PACKED_TYPES = {"left": np.int32, "right": np.int32, "feature": np.int32, "cell": np.int32, "cover": np.float64, "value": np.float64}


def packed_trees(nodes: DataFrame, thresholds: dict[int, np.ndarray]) -> DataFrame:
    """One row per tree: the arrays of ``Tree`` as binaries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def whole() -> pa.RecordBatch:
            mine = pa.Table.from_batches(held)
            tree = tree_of({c: mine.column(c).to_numpy() for c in NODE_COLUMNS}, thresholds)
            return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), *(pa.array([getattr(tree, c).astype(t).tobytes()], pa.binary()) for c, t in PACKED_TYPES.items()),
                                               pa.array([tree.root], pa.int64())], ["tree", *PACKED_TYPES, "root"])

        for b in batches:
            tree = b.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tree[lo] != last:
                    yield whole()
                    held = []
                last = int(tree[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield whole()

    return nodes.select("tree", *NODE_COLUMNS).repartition("tree").sortWithinPartitions("tree").mapInArrow(run, PACKED)


def block_numbers(cells: np.ndarray, blocks: int, grid: Sequence[int] = (), pieces: int = 1, most: int = 1) -> np.ndarray:
    """The block of each vector: vectors equal in all features but those of
    ``grid`` share one, or one per piece of the up to ``most`` cells of the first of these."""
    bits = hashed(cells)
    number = bits.sum(1) - bits[:, list(grid)].sum(1)
    if pieces > 1:
        number += hashed((cells[:, grid[0]].astype(np.int64) * pieces // most)[:, None])[:, 0]
    return ((number >> np.uint64(20)) % np.uint64(blocks)).astype(np.int32)


def over_cells(cells: DataFrame, nodes: DataFrame, thresholds: dict[int, np.ndarray],
               kernel: Callable[..., np.ndarray], width: int, with_grid: bool = False) -> DataFrame:
    """(cells, out): ``kernel`` of every distinct cell vector over all trees,
    an array of ``width`` sums. ``with_grid`` the kernel is also given the
    gridded features, and the vectors of a group come to one block."""
    spark = cells.sparkSession
    path = scratch_path(spark, "cells")
    cells.select("cells").distinct().write.parquet(path)
    distinct = spark.read.parquet(path)
    blocks = max(1, -(-distinct.count() // BLOCK_CELLS))
    shares = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))
    features = max(1, len(thresholds))
    length = 4 * features
    grid, dealing, extra = (), (), ()
    if with_grid and thresholds:
        seen = distinct.orderBy(F.xxhash64("cells")).limit(max(1, min(GRID_VECTORS, 4 * STEP_ELEMENTS // features))).collect()
        sample = np.frombuffer(b"".join(r["cells"] for r in seen), np.int32).reshape(-1, features)
        grid = tuple(gridded(sample)) if len(sample) else (0,)
        groups = len(np.unique(block_numbers(sample, 1 << 30, grid)))
        # A block has several groups; where they are too few for it, pieces of them.
        dealing, extra = (grid, -(-4 * blocks // max(1, groups)), len(thresholds[list(thresholds)[grid[0]]]) + 1), (grid,)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                held = np.frombuffer(b"".join(b.column("cells").to_pylist()), np.int32).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array(block_numbers(held, blocks, *dealing)), b.column("cells")], ["block", "cells"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b"".join(b.column("cells").to_pylist()) for b in batches]
        if any(held):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["block", "rows"])

    none = [F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in PACKED.split(", ")[1:])]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbered = distinct.mapInArrow(number, "block int, cells binary") if thresholds else distinct.select(F.lit(0).alias("block"), "cells")
    dealt = (numbered.repartitionById(blocks, "block").mapInArrow(pack, "block int, rows binary").withColumn("share", each(shares))
             .select((F.col("block") * shares + F.col("share")).cast("int").alias("task"), "rows", F.lit(-1).alias("tree"), *none))
    sent = packed_trees(nodes, thresholds).withColumn("block", each(blocks)).select(
        (F.col("block") * shares + F.pmod("tree", F.lit(shares))).cast("int").alias("task"), F.lit(None).cast("binary").alias("rows"), "tree", *PACKED_TYPES, "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = ((b, i) for b in batches for i in range(b.num_rows))
        first = next(rest, None)
        if first is None or first[0].column("rows")[first[1]].as_py() is None:
            return  # no cells in this block
        raw = first[0].column("rows")[first[1]].as_py()

        def grown() -> Iterator[Tree]:
            for b, i in rest:
                yield Tree(*(np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in PACKED_TYPES.items()), b.column("root")[i].as_py())

        out = kernel(np.frombuffer(raw, np.int32).reshape(-1, features), grown(), *extra)
        for lo in range(0, len(out), 4096):
            part = np.ascontiguousarray(out[lo:lo + 4096])
            names = [raw[k * length:(k + 1) * length] for k in range(lo, lo + len(part))]
            sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), sums], ["cells", "out"])

    found = dealt.unionByName(sent).repartitionById(blocks * shares, "task").sortWithinPartitions("tree").mapInArrow(run, "cells binary, out array<double>")
    return found.groupBy("cells").agg(F.array(*[F.sum(F.get("out", F.lit(k))) for k in range(width)]).alias("out"))


def as_array(df: DataFrame, features: str):
    return F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)


def explain_nodes(nodes: DataFrame, prepared: DataFrame, feature_names: Sequence[str], key: str = "loan_no",
                  features: str = "features", with_value: bool = False) -> DataFrame:
    """(key, feature, phi) for every row of ``prepared`` and every feature of
    its vector (or array) column ``features`` under the trees of ``nodes``;
    ``with_value`` adds the feature's (prepared) value. Repeated rows and
    keys give repeated results; no rows, none."""
    thresholds = threshold_table(nodes)
    rows = with_cells(prepared.select(key, as_array(prepared, features).alias("x")), thresholds)
    rows = rows if with_value else rows.select(key, "cells")
    found = over_cells(rows, nodes, thresholds, ensemble_shap, max(1, len(thresholds)), with_grid=True)
    at = {f: k for k, f in enumerate(thresholds)}
    entries = F.array(*[F.struct(F.lit(name).alias("feature"), (F.col("out")[at[f]] if f in at else F.lit(0.0)).alias("phi"),
                                 *([F.col("x")[f].alias("value")] if with_value else [])) for f, name in enumerate(feature_names)])
    return rows.join(found, "cells").select(key, F.explode(entries).alias("e")).select(key, "e.*")


def score_nodes(nodes: DataFrame, prepared: DataFrame, features: str = "features", name: str = "score") -> DataFrame:
    """``prepared`` without ``features``, and as ``name`` the sum over the trees
    of ``nodes`` of the value of the leaf that a row reaches; its cells decide."""
    thresholds = threshold_table(nodes)
    kept = [c for c in prepared.columns if c != features]
    rows = with_cells(prepared.select(*kept, as_array(prepared, features).alias("x")), thresholds).drop("x")
    return rows.join(over_cells(rows, nodes, thresholds, ensemble_score, 1), "cells").select(*kept, F.col("out")[0].alias(name))


def shap_values(model, prepared: DataFrame, feature_names: Sequence[str], key: str = "loan_no",
                features: str = "features", with_value: bool = False) -> DataFrame:
    """``explain_nodes`` of a fitted Spark ML ensemble."""
    nodes, _ = known_nodes(model, prepared.sparkSession)
    return explain_nodes(nodes, prepared, feature_names, key, features, with_value)


def summary(shap: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The rows of ``shap`` (with values) of its k strongest features: what an
    attribution summary shows, attribution against feature value."""
    return shap.join(top_features(shap, k).select("feature"), "feature", "left_semi")


def top_features(shap: DataFrame, k: int = TOP_FEATURES) -> DataFrame:
    """The k features with the largest mean absolute attribution (a top-k report)."""
    return (shap.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
            .orderBy(F.desc("mean_abs_phi"), "feature").limit(k))
