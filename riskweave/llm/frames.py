"""Helpers shared by the operators: Arrow text views, empty-safe batches and
scratch tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.session import scratch_path

# Bytes of text that one numpy step handles; longer documents are taken in
# slices by the operators that can, or alone by the others.
CHUNK_BYTES = 1 << 20


# Rows and bytes of one Arrow batch between Spark and Python: what a task holds, whatever the texts' lengths.
BATCH_DEFAULTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def bounded_batches(spark: SparkSession) -> None:
    """Give the session the bounds above where it sets none of its own; a
    limit that the user has set stays as it is, in whatever notation."""
    held = spark.conf.getAll
    for key, most in BATCH_DEFAULTS.items():
        if key not in held:
            spark.conf.set(key, most)


def with_fallback(df: DataFrame, **types: str) -> DataFrame:
    """The named columns of ``df``, cast; a missing one becomes null."""
    bounded_batches(df.sparkSession)
    have = set(df.columns)
    return df.select(*[(df[c] if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back
    (lineage cut that survives lost executors)."""
    return stored(df, name)[0]


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written``, with the path for ``delete`` once all readers are done."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Scratch tables that are deleted together when their readers are done."""

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        out, path = stored(df, name)
        self.paths.append((df.sparkSession, path))
        return out

    def drop(self) -> None:
        for spark, path in self.paths:
            delete(spark, path)
        self.paths.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each (one at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def text_pieces(texts: list, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of a list of strings holding about ``limit`` characters each."""
    i, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield i, k + 1
            i, size = k + 1, 0
    if i < len(texts):
        yield i, len(texts)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def keep_rows(tagged: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of ``tagged`` whose (doc_id, ``key``) is in ``kept`` (doc_id,
    key), without ``key``; of rows that repeat both one stays. Rows with a
    null key stay all. Only hits are compared, so that a hot key is just
    another key on the other side of the join."""
    columns = [c for c in tagged.columns if c != key]
    wanted = kept.groupBy("doc_id", "key").agg((F.count("*") > 1).alias("many"))
    wanted = wanted.select(F.col("doc_id").alias("kept_doc"), F.col("key").alias("kept_key"), F.col("many").alias("kept_many"))
    taken = set(tagged.columns)
    for c in list(wanted.columns):
        while c in taken:
            wanted = wanted.withColumnRenamed(c, c + "_")
            c += "_"
    doc, k, many = wanted.columns
    found = tagged.join(wanted, (tagged[key] == wanted[k]) & tagged["doc_id"].eqNullSafe(wanted[doc]))
    once = found.where(~F.col(many)).select(*columns)
    first = found.where(F.col(many)).dropDuplicates([key, "doc_id"]).select(*columns)
    return once.unionByName(first).unionByName(tagged.where(tagged[key].isNull()).select(*columns))
