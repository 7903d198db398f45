"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.frames import delete, stored, written


def stars(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over (a, b). Edges arrive sorted by (a, b), so that the
    first neighbour of a node is its smallest and a node of any degree is
    streamed. Large star: larger neighbours point to the smallest around the
    node. Small star (edges with b < a): the node and its neighbours do."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = least = before = None
        for batch in batches:
            out_a, out_b = [], []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if a != node:
                    node, before, least = a, None, b if small else min(a, b)
                    if small:
                        out_a.append(a)
                        out_b.append(least)
                if b != before:
                    if b != least and (small or b > a):
                        out_a.append(b)
                        out_b.append(least)
                    before = b
            yield pa.RecordBatch.from_arrays([pa.array(out_a, batch.schema.field("a").type), pa.array(out_b, batch.schema.field("b").type)], ["a", "b"])

    return edges.repartition("a").sortWithinPartitions("a", "b").mapInArrow(run, edges.schema)


def state(edges: DataFrame) -> tuple:
    """Number of edges and a sum over their hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, step: Callable = stars) -> DataFrame:
    """``edges`` (a, b: any comparable type) -> (node, root): every node that
    has an edge, with the smallest node of its component. Large and small
    stars in turn point every node to a smaller one until nothing changes:
    then all edges are stars. Each turn is written to the shared folder.
    Duplicate edges and loops are harmless; no edge gives no row."""
    ends = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(ends.distinct(), "edges")
    now, last, held = edges.where("a <> b"), None, None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        now, path = stored(step(step(both, small=False), small=True), "edges")
        if held:
            delete(edges.sparkSession, held)  # the turn before has been read
        held, following = path, state(now)
        if following == last:
            break
        last = following
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    alone = edges.where("a = b").select(F.col("a").alias("node"))
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    return found.unionByName(alone.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
