"""Splittable reading of quoted CSV: one big file is read by many tasks.

A quoted cell may hold line breaks, so whether a line starts a record
depends on all quotes before it. The files are read as lines, which Spark
splits by byte ranges, in two passes:

1. every range states for both cases, beginning outside or inside a quoted
   cell, how it ends and whether a record ends in it, and its lines;
2. a prefix over the ranges of each file (one row per range, held by the
   driver: 128 MB of input each by default) settles in which case every
   range is and where its first line stands; then each range puts its lines
   together to records. The pieces of a record that crosses ranges are
   joined by the range in which it began.

Only lines with a quote are walked cell by cell. Cells are then parsed by
Spark's own CSV expression. Lines end in LF or CR LF.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPTIONS = {"quote": '"', "escape": '"'}

# FIXED VALUES: names of the record errors.
TOO_MANY, TOO_FEW = "too many cells", "too few cells"

RANGE = "key bigint, path string, start bigint, lines bigint, ends_0 boolean, ends_1 boolean, closed_0 boolean, closed_1 boolean"
PIECE = "path string, line bigint, opener bigint, start bigint, cells int, record string"


def walk(line: str, inside: bool) -> tuple[bool, int]:
    """(inside a quoted cell at the end, delimiters met) of a line that starts
    inside or outside one. A quote opens a cell only as its first character,
    a doubled one inside stands for itself, and what follows a closing quote
    up to the delimiter belongs to the cell."""
    at, delimiters = 0, 0
    while True:
        if not inside and line.startswith('"', at):
            inside, at = True, at + 1
        while inside:
            at = line.find('"', at)
            if at < 0:
                return True, delimiters
            if line.startswith('""', at):
                at += 2
            else:
                inside, at = False, at + 1
        at = line.find(",", at) + 1
        if not at:
            return False, delimiters
        delimiters += 1


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, start, key): the lines of all files, in order within each
    byte range; ``key`` names the range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    where = [F.col(f"_metadata.file_{c}").alias(c) for c in ("path", "block_start", "block_length")]
    return lines.select("value", *where).select("value", "path", F.col("block_start").alias("start"),
                                                F.xxhash64("path", "block_start", "block_length").alias("key"))


def in_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(whether a new range starts, rows of one range) in order."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            yield key[lo] != last, b.slice(lo, hi - lo)
            last = key[lo]


def scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "path", "start", "lines", "ends_0", "ends_1", "closed_0", "closed_1"]
    held: list | None = None
    for new, rows in in_ranges(batches):
        if new:
            if held:
                yield pa.RecordBatch.from_pylist([dict(zip(names, held))], schema=_arrow(RANGE))
            held = [rows.column("key")[0].as_py(), rows.column("path")[0].as_py(), rows.column("start")[0].as_py(), 0, False, True, False, False]
        held[3] += rows.num_rows
        value = rows.column("value")
        quoted = np.flatnonzero(pc.match_substring(value, '"').to_numpy(zero_copy_only=False))
        plain = rows.num_rows > len(quoted)
        for case in (0, 1):
            state, closed, before = held[4 + case], held[6 + case], -1
            for k in quoted.tolist():
                closed |= k > before + 1 and not state  # a line without quotes in between
                state, _ = walk(value[k].as_py(), state)
                closed |= not state
                before = k
            closed |= plain and before + 1 < rows.num_rows and not state
            held[4 + case], held[6 + case] = state, closed
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(names, held))], schema=_arrow(RANGE))


def _arrow(schema: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(name, types[kind]) for name, kind in (c.split(" ") for c in schema.split(", "))])


def settled(ranges: list) -> dict[str, np.ndarray]:
    """Per range, sorted by key: whether it begins inside a cell, the start of
    the range in which the record open at its beginning began, and the
    number of lines before it."""
    out, before = [], None
    for r in sorted(ranges, key=lambda r: (r["path"], r["start"])):
        if r["path"] != before:
            before, inside, opener, line = r["path"], False, 0, 0
        out.append((r["key"], inside, opener, line))
        ends, closed = (r["ends_1"], r["closed_1"]) if inside else (r["ends_0"], True)
        if ends and closed:
            opener = r["start"]
        inside, line = ends, line + r["lines"]
    out.sort()
    keys = np.array([o[0] for o in out], np.int64)
    if len(np.unique(keys)) < len(keys):
        raise RuntimeError("two byte ranges share a hash")
    return {"key": keys, "inside": np.array([o[1] for o in out], bool), "opener": np.array([o[2] for o in out], np.int64), "line": np.array([o[3] for o in out], np.int64)}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, cells, record): every record of the CSV files at ``path``,
    headers included, with the number of its first line and of its cells;
    empty lines between records are none. Runs one job over the lines."""
    lines = read_lines(spark, path)
    known = settled(lines.mapInArrow(scan_ranges, RANGE).collect())
    schema = _arrow(PIECE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        open_: list[str] = []
        state = None

        def flush():
            nonlocal out
            done, out = out, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        def finish():  # a record that goes on in the next range
            if open_:
                out.append((state["path"], state["first"], state["opener"], state["start"], state["cells"], "\n".join(open_)))
                open_.clear()

        for new, rows in in_ranges(batches):
            if new:
                finish()
                k = int(np.searchsorted(known["key"], key := rows.column("key")[0].as_py()))
                if k == len(known["key"]) or known["key"][k] != key:
                    raise RuntimeError("the byte ranges of the input changed between the two passes")
                start, inside = rows.column("start")[0].as_py(), bool(known["inside"][k])
                # Lines of a record from an earlier range are a piece of that one.
                state = {"path": rows.column("path")[0].as_py(), "start": start, "line": int(known["line"][k]), "inside": inside, "first": None if inside else 0,
                         "opener": int(known["opener"][k]) if inside else None, "cells": 0}
            value = rows.column("value").to_pylist()
            commas = pc.count_substring(rows.column("value"), ",").to_pylist()
            for text, delimiters in zip(value, commas):
                state["line"] += 1
                if not open_ and not state["inside"]:
                    state.update(first=state["line"], opener=None, cells=1)
                if '"' in text:
                    state["inside"], delimiters = walk(text, state["inside"])
                elif state["inside"]:
                    delimiters = 0
                state["cells"] += delimiters
                open_.append(text)
                if state["inside"]:
                    if state["opener"] is None:
                        state["opener"] = state["start"]
                    continue
                whole = state["first"] is not None and (state["opener"] is None or state["opener"] == state["start"])
                record = "\n".join(open_).removesuffix("\r")
                if not whole or record:
                    # A piece of an earlier range's record keeps that range; a whole record needs none.
                    out.append((state["path"], state["first"], None if whole else state["opener"], state["start"], state["cells"], record))
                open_.clear()
            if len(out) >= 2000:
                yield flush()
        finish()
        if out:
            yield flush()

    pieces = lines.mapInArrow(run, PIECE)
    whole = pieces.where("opener is null").select("path", "line", "cells", "record")
    parts = pieces.where("opener is not null").groupBy("path", "opener").agg(
        F.array_sort(F.collect_list(F.struct("start", "line", "cells", "record"))).alias("p"))
    joined = parts.select("path", F.array_max("p.line").alias("line"), F.aggregate("p.cells", F.lit(0), lambda a, x: a + x).alias("cells"),
                          F.array_join("p.record", "\n").alias("record"))
    return whole.unionByName(joined)


def read_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(panel, rejected) of the CSV files at ``path``, all cells as text.

    The header of the first file names the columns; the first record of each
    file is its header. A record with too few cells stays in the panel, the
    missing ones null, and one with too many is kept apart; both are listed
    in ``rejected`` (path, line, cells, error, record)."""
    columns = spark.read.options(header=True, inferSchema=False, multiLine=True, **OPTIONS).csv(path).columns
    records = read_records(spark, path).where("line > 1")
    cells = F.from_csv("record", ", ".join(f"`{c.replace('`', '``')}` string" for c in columns), OPTIONS)
    panel = records.where(F.col("cells") <= len(columns)).select(cells.alias("r")).select("r.*")
    error = F.when(F.col("cells") > len(columns), TOO_MANY).otherwise(TOO_FEW)
    rejected = records.where(F.col("cells") != len(columns)).select("path", "line", "cells", error.alias("error"), "record")
    return panel, rejected
