"""Approximate nearest neighbours by vantage-point trees per shard.

Cosine order equals the order of the chord between unit vectors, which is a
metric. The vectors of a shard form one tree: a node holds a vantage point
and the radius that halves the rest. A query visits the far side of a node
only if the triangle inequality, its bound multiplied by a relaxation
factor, leaves room for a nearer vector than its k-th so far; factor one is
exact, larger factors prune more. All queries of a block descend a tree
together.

The same rule holds one level up: shards are the vectors nearest to one of
at most PIVOTS pivots (a crowded one has several), and know their radius.
A query first searches one shard of its own pivot; the k-th distance found
there tells by the triangle inequality which other shards can hold a nearer
vector, and only those are searched. Tasks are numbered by shard: a task
takes its tree, then the queries sent to it, block after block. The best k
of all shards are merged by a grouped sort.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.frames import with_fallback, written

K = 5
RELAX = 1.0
# Vectors of a shard and queries of a block, on average: what one task holds.
SHARD_ROWS = 4096
BLOCK_ROWS = 2048
LEAF_ROWS = 64
# Pivots of all shards of one vector length, at most: what the driver holds.
PIVOTS = 1024
# A search keeps so many more than k, for the exact scores to settle rounding; of rows that tie up to
# SLACK in chord it keeps all, however many.
SPARE, SLACK = 8, 1e-7

# Tasks of a search at most; shards are dealt over them.
MOST_TASKS = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part: not null, not empty,
    no null or non-finite component, not all zero; in double precision."""
    rows = with_fallback(vectors, vec_id="bigint", embedding="array<double>").withColumnRenamed("embedding", "v")
    sound = F.coalesce(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))), F.lit(False))
    return rows.where(F.col("v").isNotNull() & sound & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows by powers of two to about one: exact, and squares cannot overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


# --- tree --------------------------------------------------------------------

def build(ids: np.ndarray, v: np.ndarray, seed: int = 11) -> dict:
    """Tree over the rows of ``v`` in one array order: every node is a range
    [lo, hi) of rows; row lo is its vantage point, the nearer half follows.
    ``ids`` ascend, so that the row number given settles ties."""
    rng = np.random.default_rng(seed)
    u, order = unit(v), np.arange(len(v))
    nodes: list[tuple] = []  # lo, middle, hi, near radius, far radius, near child, far child
    work = [(0, len(v), -1, 0)]
    while work:
        lo, hi, parent, side = work.pop()
        here = len(nodes)
        if parent >= 0:
            nodes[parent][5 + side] = here
        node = [lo, hi, hi, 0.0, 0.0, -1, -1]
        nodes.append(node)
        if hi - lo <= LEAF_ROWS:
            continue
        pick = lo + int(rng.integers(hi - lo))
        order[[lo, pick]] = order[[pick, lo]]
        d = chord(u[order[lo + 1:hi]] @ u[order[lo]])
        sorting = np.argsort(d, kind="stable")
        order[lo + 1:hi] = order[lo + 1:hi][sorting]
        d = d[sorting]
        if d[-1] == d[0]:
            continue  # all at one distance: no radius halves them
        half = len(d) // 2
        node[1], node[3], node[4] = lo + 1 + half, float(d[half - 1]), float(d[half])
        work += [(lo + 1 + half, hi, here, 1), (lo + 1, lo + 1 + half, here, 0)]
    return {"ids": ids[order], "v": v[order], "number": order, "nodes": [tuple(n) for n in nodes]}


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class Best:
    """The nearest rows of every query so far: chord, then row number."""

    def __init__(self, queries: int, k: int):
        self.d = np.full((queries, k), np.inf)
        self.number = np.full((queries, k), -1)

    def add(self, q: np.ndarray, number: np.ndarray, d: np.ndarray, own: np.ndarray) -> None:
        """Offer rows at chords ``d`` (queries x rows) to queries ``q``,
        except where ``own`` marks the query's own row."""
        d = np.concatenate([self.d[q], np.where(own, np.inf, d)], 1)
        number = np.concatenate([self.number[q], np.broadcast_to(number, own.shape)], 1)
        order = np.lexsort((number, d), axis=1)[:, :self.d.shape[1]]
        self.d[q], self.number[q] = np.take_along_axis(d, order, 1), np.take_along_axis(number, order, 1)


def search(tree: dict, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> Best:
    """The k nearest rows of the tree for each query; all queries together."""
    u, q = unit(tree["v"]), unit(queries)
    best, nodes = Best(len(q), k), tree["nodes"]
    work = [(0, np.arange(len(q)), np.zeros(len(q)))]
    while work:
        here, active, bound = work.pop()
        keep = relax * bound <= best.d[active, -1] + SLACK  # rows that tie up to rounding are not pruned
        active = active[keep]
        if not len(active):
            continue
        lo, middle, hi, near, far, left, right = nodes[here]
        if left < 0:
            for s in range(lo, hi, 2048):
                e = min(hi, s + 2048)
                best.add(active, tree["number"][s:e], chord(q[active] @ u[s:e].T), query_ids[active, None] == tree["ids"][None, s:e])
            continue
        d = chord(q[active] @ u[lo])
        best.add(active, tree["number"][lo:lo + 1], d[:, None], query_ids[active, None] == tree["ids"][None, lo:lo + 1])
        inside, outside = np.maximum(d - near, 0), np.maximum(far - d, 0)
        close = inside <= outside
        # Depth first, the likelier side first: the last pushed is taken first.
        for side in (~close, close):
            if side.any():
                rows = active[side]
                first, second = (left, inside), (right, outside)
                if side is not close:
                    first, second = second, first
                work += [(second[0], rows, np.maximum(second[1][side], 0)), (first[0], rows, first[1][side])]
    return best


def settled(tree: dict, ids: np.ndarray, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of the tree, chord) of at least the k nearest rows of each
    query and of all that tie with the k-th up to rounding: the list grows
    for the queries whose last place still ties."""
    out, todo, keep = [], np.arange(len(ids)), k + SPARE
    while len(todo):
        best = search(tree, ids[todo], queries[todo], keep, relax)
        open_ = (best.d[:, -1] <= best.d[:, k - 1] + SLACK) & (keep < len(tree["ids"]))
        done = np.flatnonzero(~open_)
        hit = ~np.isinf(best.d[done])
        out.append((todo[done][np.nonzero(hit)[0]], best.number[done][hit], best.d[done][hit]))
        todo, keep = todo[open_], 2 * keep
    query, number, d = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return query, np.argsort(tree["number"])[number.astype(np.int64)], d


# --- Spark -------------------------------------------------------------------

def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def vectors_of(b: pa.RecordBatch) -> np.ndarray:
    return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def one_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch by length of their vectors."""
    for b in batches:
        size = b.column("dim").to_numpy()
        for dim in np.unique(size):
            yield b.filter(pa.array(size == dim)) if (size != dim).any() else b


def pick_pivots(candidates: DataFrame, count: int, shard_rows: int) -> dict[int, np.ndarray]:
    """Unit pivots by vector length: as many of all lengths as shards are
    needed, at most PIVOTS of one length, the vectors of the smallest hashes."""
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vec_id"), "vec_id", "v")
    wanted = max(1, min(PIVOTS, -(-count // shard_rows)))
    rows = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted).select("dim", "v").collect()
    return {dim: unit(np.array([r["v"] for r in rows if r["dim"] == dim])) for dim in sorted({r["dim"] for r in rows})}


def near_pivot(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the number of the nearest pivot of their length (counted
    over all lengths) and the chord to it."""
    first = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in one_length(batches):
            dim = b.column("dim")[0].as_py()
            d = chord(unit(vectors_of(b)) @ pivots[dim].T)
            near = d.argmin(1)
            yield b.append_column("pivot", pa.array(near + first[dim], pa.int32())).append_column("d", pa.array(d[np.arange(len(near)), near]))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("pivot", T.IntegerType()), T.StructField("d", T.DoubleType())]))


def searched(trees: DataFrame, asked: DataFrame, shards: int, k: int, relax: float, block_rows: int) -> DataFrame:
    """(query_id, number, vec_id, score, bound): the nearest rows of its shard
    for every query of ``asked`` (shard, number, vec_id, v); bound is the
    chord of its k-th row there (infinite if there are fewer)."""
    queries = asked.select("shard", F.lit(None).cast("binary").alias("tree"), "number", "vec_id", "v", "dim")
    both = queries.unionByName(trees.select("shard", "tree", F.lit(-1).cast("bigint").alias("number"), F.lit(None).cast("bigint").alias("vec_id"),
                                            F.lit(None).cast("array<double>").alias("v"), F.lit(None).cast("int").alias("dim")))

    def answer(tree: dict, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, numbers = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "number"))
        q = np.concatenate([vectors_of(b) for b in held])
        row, at, d = settled(tree, ids, q, k, relax)
        bound, place = np.full(len(ids), np.inf), np.lexsort((d, row))
        start = np.searchsorted(row[place], np.arange(len(ids)))
        size = np.searchsorted(row[place], np.arange(len(ids)), "right") - start
        full = np.flatnonzero(size >= k)
        bound[full] = d[place][start[full] + k - 1]
        some = np.flatnonzero(size == 0)  # a query that met none is still to be sent on
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([ids[row], ids[some]])), pa.array(np.concatenate([numbers[row], numbers[some]])),
             pa.concat_arrays([pa.array(tree["ids"][at]), none]), pa.concat_arrays([pa.array(cosines(q[row], tree["v"][at])), pa.nulls(len(some), pa.float64())]),
             pa.array(np.concatenate([bound[row], bound[some]]))], ["query_id", "number", "vec_id", "score", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, held, size, last = None, [], 0, None
        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else []
            for lo, hi in zip(cuts, cuts[1:]):
                part = b.slice(lo, hi - lo)
                if shard[lo] != last:  # the tree of a shard comes first
                    if held:
                        yield answer(tree, held)
                    tree, held, size, last = pickle.loads(part.column("tree")[0].as_py()), [], 0, shard[lo]
                    part = part.slice(1)
                for at in range(0, part.num_rows, block_rows):
                    held.append(part.slice(at, block_rows))
                    size += held[-1].num_rows
                    if size >= block_rows:
                        yield answer(tree, held)
                        held, size = [], 0
        if held:
            yield answer(tree, held)

    return both.repartitionById(min(shards, MOST_TASKS), F.pmod("shard", F.lit(min(shards, MOST_TASKS)))).sortWithinPartitions(
        "shard", F.col("number") >= 0).mapInArrow(run, "query_id bigint, number bigint, vec_id bigint, score double, bound double")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, relax: float = RELAX,
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id,
    embedding) for which ``is_query`` holds, its ``k`` nearest other rows by
    cosine, ties to the smaller vec_id, or all if there are fewer.

    Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do rows without vec_id. Vectors of
    different lengths are not compared. Rows with the query's own vec_id are
    not its neighbours. Rows that repeat vec_id and vector count once; a
    vec_id with different vectors is a candidate with each, once at its best,
    and as a query by the union of its searches. No rows, no result.
    """
    spark = vectors.sparkSession
    rows = written(usable(vectors).where("vec_id is not null").dropDuplicates(["vec_id", "v"]), "vectors")
    # Of equal vectors no query needs more than the k + 1 smallest ids.
    equal = Window.partitionBy("v").orderBy("vec_id")
    candidates = written(rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1).drop("place"), "candidates")
    pivots = pick_pivots(candidates, candidates.count(), shard_rows)
    if not pivots:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    placed = written(near_pivot(candidates, pivots), "placed")
    # Shards of each pivot: by its rows, one at least, so that every query has a shard of its own pivot.
    sizes = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    counts = [max(1, -(-sizes.get(p, 0) // shard_rows)) for p in range(sum(map(len, pivots.values())))]
    first = np.cumsum([0, *counts]).tolist()
    shards = first[-1]
    table = spark.createDataFrame([(p, first[p], n) for p, n in enumerate(counts)], "pivot int, first int, parts int")

    def in_shards(df: DataFrame, hashed: Column) -> DataFrame:
        return df.join(table, "pivot").withColumn("shard", (F.col("first") + F.pmod(hashed, F.col("parts"))).cast("int")).drop("first", "parts")

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        tree = pickle.dumps(build(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["v"])), 5)
        return pd.DataFrame({"shard": [key[0]], "pivot": [pdf["pivot"].iloc[0]], "radius": [pdf["d"].max()], "tree": [tree]})

    hashed = F.xxhash64("vec_id", "v")
    grown = in_shards(placed, hashed).groupBy("shard").applyInPandas(grow, "shard int, pivot int, radius double, tree binary")
    trees = written(grown, "trees")
    # All shards with their pivots and radii: a row per shard_rows vectors.
    known = trees.select("shard", "pivot", "radius").collect()
    have, of, radius = (np.array([r[c] for r in known]) for c in ("shard", "pivot", "radius"))
    asked = written(near_pivot(rows.where(is_query).withColumn("number", F.monotonically_increasing_id()), pivots), "queries")
    own = written(in_shards(asked, hashed).join(trees.select("shard"), "shard", "left_semi"), "first-shards")
    one = written(searched(trees, own.drop("pivot", "d"), shards, k, relax, block_rows), "first-found")
    bounds = one.groupBy("number").agg(F.min("bound").alias("bound"))
    following = asked.join(bounds, "number", "left").join(own.select("number", F.col("shard").alias("done")), "number", "left")
    starts = dict(zip(pivots, np.cumsum([0, *map(len, pivots.values())]).tolist()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in one_length(batches):
            dim = b.column("dim")[0].as_py()
            mine = np.flatnonzero((of >= starts[dim]) & (of < starts[dim] + len(pivots[dim])))
            to = chord(unit(vectors_of(b)) @ pivots[dim].T)[:, of[mine] - starts[dim]]
            bound = b.column("bound").to_numpy(zero_copy_only=False)
            bound = np.where(np.isnan(bound), np.inf, bound)
            # No vector of a shard is nearer than its pivot's chord less its radius.
            room = relax * (to - radius[mine]) <= bound[:, None] + SLACK
            room &= have[mine][None, :] != b.column("done").to_numpy(zero_copy_only=False)[:, None]
            row, shard = np.nonzero(room)
            for lo in range(0, len(row), 4096):
                some = b.take(pa.array(row[lo:lo + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(have[mine][shard[lo:lo + 4096]], pa.int32()), some.column("number"), some.column("vec_id"),
                                                  some.column("v"), some.column("dim")], ["shard", "number", "vec_id", "v", "dim"])

    sent = following.select("number", "vec_id", "v", "dim", "bound", "done").mapInArrow(send, "shard int, number bigint, vec_id bigint, v array<double>, dim int")
    two = searched(trees, sent, shards, k, relax, block_rows)
    met = one.unionByName(two).where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision."""
    if not len(q):
        return np.zeros(0)
    q, v = scaled(q), scaled(v)
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))
