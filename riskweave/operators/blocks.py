"""Distinct cell vectors in blocks: one row holds some thousand vectors as
binary columns, so that a pass over them costs numpy time, not row time.

A block has the columns ``cells`` (features x vectors, 16 bits a cell if
all fit) and, for every further number, one binary column of 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.session import scratch_path

# Distinct vectors of a block and of one task's blocks, at most.
BLOCK_ROWS, PART_ROWS = 1 << 15, 1 << 20


def cell_type(sizes: Sequence[int]) -> np.dtype:
    """The type of cells that number up to ``sizes`` per feature."""
    return np.dtype(np.uint16 if max(sizes, default=0) <= 1 << 16 else np.int32)


def stored_blocks(vectors: DataFrame, sizes: Sequence[int], numbers: dict[str, type], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, str, int]:
    """(blocks, their path, number of vectors) of ``vectors``: ``cells`` (int32
    bytes of one vector) and the columns ``numbers``. They are dealt by a hash
    and sorted, so that the same vectors give the same blocks."""
    spark = vectors.sparkSession
    path, raw = scratch_path(spark, "blocks"), scratch_path(spark, "vectors")
    vectors.write.parquet(raw)
    held = spark.read.schema(vectors.schema).parquet(raw)
    rows = held.count()
    tasks = max(1, min(2 * spark.sparkContext.defaultParallelism, -(-rows // 1024)), -(-rows // PART_ROWS))
    width, kind, names = len(sizes), cell_type(sizes), ["cells", *numbers]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                part = b.slice(lo, block_rows)
                cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.int32).reshape(-1, width)
                columns = [np.ascontiguousarray(cells.T.astype(kind)), *(part.column(c).to_numpy(zero_copy_only=False).astype(t) for c, t in numbers.items())]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names)

    schema = ", ".join(f"{c} binary" for c in names)
    held.repartition(tasks, "cells").sortWithinPartitions("cells").mapInArrow(pack, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path), path, rows


def unpacked(batches: Iterator[pa.RecordBatch], width: int, kind: np.dtype, numbers: dict[str, type]) -> Iterator[tuple[np.ndarray, ...]]:
    """(cells, one array per column of ``numbers``) of every block."""
    for b in batches:
        for i in range(b.num_rows):
            cells = np.frombuffer(b.column("cells")[i].as_buffer(), kind).reshape(width, -1)
            yield cells, *(np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in numbers.items())


def places(cells: np.ndarray, left: np.ndarray, right: np.ndarray, feature: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """The node that each vector of ``cells`` (features x vectors) reaches from
    node 0; children come after their parents, a leaf has left -1."""
    n = cells.shape[1]
    flat, own, at = np.ravel(cells), np.arange(n), np.zeros(n, np.int64)
    leaf = left < 0
    number = np.arange(len(left))
    child = np.stack([np.where(leaf, number, left), np.where(leaf, number, right)], 1).ravel()
    start, level = np.where(leaf, 0, feature).astype(np.int64) * n, np.array([0])
    while len(level := level[left[level] >= 0]):
        at = child.take(2 * at + (flat.take(start.take(at) + own) > cell.take(at)))
        level = np.concatenate([left[level], right[level]])
    return at
