"""Replaceable tables: a table is a folder of versions, of which the last complete one counts.

``replace_table`` creates or replaces a stored table (Parquet, optionally
partitioned, e.g. by ``year`` so filters on it prune files) by a new version,
``read_table`` reads it, ``drop_versions`` deletes old ones.
"""

from __future__ import annotations

import time
import uuid
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# An empty file that is written last: a version without it is not complete.
COMMITTED = "_COMMITTED"


def _folder(spark: SparkSession, path: str):
    """(file system, Hadoop path) of ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str, complete: bool = True) -> list[str]:
    """Names of the versions of the table at ``path``, oldest first."""
    fs, folder = _folder(spark, path)
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory() and s.getPath().getName().startswith("version-"))
    marker = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in names if not complete or fs.exists(marker(f"{path}/{n}/{COMMITTED}"))]


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> str:
    """Create or replace the table at ``path``; returns the path.

    The rows are written as a version of its own, which a marker file makes
    the current one as the last step: whenever a writer dies, readers find
    the version before, whole, and a frame that reads the table can replace
    it. No folder is moved or deleted, so this holds on object stores too.
    Of two writers at once the one with the larger name stays, whole.

    Partitioned tables are rebalanced by their columns before the write:
    few files per value, and a value with many rows is split."""
    spark = df.sparkSession
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    known = versions(spark, path, complete=False)
    number = int(known[-1].split("-")[1]) + 1 if known else 0
    version = f"{path}/version-{number:010d}-{uuid.uuid4().hex}"
    w = df.write.format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(version)
    fs, _ = _folder(spark, version)
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{version}/{COMMITTED}"), False).close()
    return path


def current(spark: SparkSession, path: str) -> str:
    """Where the rows of ``path`` lie: its current version if it is a
    replaceable table, else ``path`` itself. A replaceable table without
    a complete version raises."""
    known = versions(spark, path, complete=False)
    if not known:
        return path
    complete = versions(spark, path)
    if not complete:
        raise FileNotFoundError(f"no complete version of a table at {path}")
    return f"{path}/{complete[-1]}"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The rows of the table at ``path`` as its last complete version has them."""
    return spark.read.format(fmt).load(current(spark, path))


def drop_versions(spark: SparkSession, path: str, older_than_seconds: float = 7 * 24 * 3600.0) -> list[str]:
    """Delete the versions, complete or not, that are older than the current
    one and were last written to more than ``older_than_seconds`` ago;
    returns their names. Readers that still use one must be done by then."""
    known = versions(spark, path)
    fs, _ = _folder(spark, path)
    limit, gone = (time.time() - older_than_seconds) * 1000, []
    for name in versions(spark, path, complete=False):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if known and name < known[-1] and fs.getFileStatus(folder).getModificationTime() <= limit:
            fs.delete(folder, True)
            gone.append(name)
    return gone
