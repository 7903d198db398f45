"""Exact deduplication of incoming batches against an immutable snapshot.

A snapshot is split into buckets by the leading bits of the SHA-256 of the
normalised text (A-Z lower-cased, null as empty). Per bucket a static
binary fuse filter (three hashed slots in neighbouring segments, 16-bit
fingerprints, built by peeling) is stored. Incoming digests are grouped
among themselves first (one row per distinct digest, combined before the
shuffle) and screened by the filter of their bucket: a miss proves that the
snapshot lacks the text; a hit is joined with the exact bucket. Groups of
two and more rows are then checked byte by byte: the smallest and the
largest text of a group must be the same string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.frames import batch, with_fallback, written

# Distinct digests of a bucket on either side, on average; a filter is built by
# one task, and one task probes a bucket's incoming digests.
BUCKET_KEYS = 4096
# Salts of the byte check: copies of one text spread over so many groups.
SALTS = 32

KEYED = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("in_snapshot", pa.bool_())])
TEXTS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("text", pa.binary())])


def normalised(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 with A-Z lower-cased; null is empty."""
    return [b"" if t is None else t.lower() for t in column.cast(pa.binary()).to_pylist()]


def digests(docs: DataFrame, in_snapshot) -> DataFrame:
    """doc_id, digest, in_snapshot of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(KEYED, doc_id=b.column("doc_id"), in_snapshot=b.column("in_snapshot"),
                        digest=[hashlib.sha256(t).digest() for t in normalised(b.column("text"))])

    rows = with_fallback(docs, doc_id="bigint", text="string").withColumn("in_snapshot", F.coalesce(in_snapshot, F.lit(False)))
    return rows.mapInArrow(run, "doc_id bigint, digest binary, in_snapshot boolean")


# --- binary fuse filter ---------------------------------------------------

def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key, in three neighbouring segments."""
    h = (keys ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    first = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
    mask = np.uint64(segment - 1)
    places = [h & mask, (h >> np.uint64(13)) & mask, (h >> np.uint64(26)) & mask]
    return np.stack([(first + np.uint64(k)) * np.uint64(segment) + p for k, p in enumerate(places)], 1).astype(np.int64)


def _prints(keys: np.ndarray, seed: int) -> np.ndarray:
    h = (keys + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(48)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> dict:
    """Binary fuse filter over 64-bit keys: seed, segment length, segment
    count and the table of fingerprints. No key is ever missed; a foreign
    key passes with probability 2^-16."""
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    if n == 0:
        return {"seed": 0, "segment": 0, "segments": 0, "prints": b""}
    segment = 1 << int(np.clip(np.floor(np.log(n) / np.log(3.33) + 2.25), 2, 12))
    load = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, int(np.ceil(n * load / segment)) - 2)
    for seed in range(1, 1000):
        slots = _slots(keys, seed, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # xor of the key numbers in a slot
        np.bitwise_xor.at(owner, slots.ravel(), np.repeat(np.arange(n), 3))
        waves, alive = [], np.ones(n, bool)
        while True:  # peel all slots of one key at once
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            who, where = np.unique(owner[single], return_index=True)
            alive[who] = False
            waves.append((who, single[where]))
            gone = slots[who].ravel()
            np.subtract.at(count, gone, 1)
            np.bitwise_xor.at(owner, gone, np.repeat(who, 3))
        if not alive.any():
            break
    else:
        raise RuntimeError("no seed gives a filter; the keys of a bucket are too many")
    table, want = np.zeros(size, np.uint16), _prints(keys, seed)
    for who, own in reversed(waves):
        table[own] = 0
        s = slots[who]
        table[own] = want[who] ^ table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]
    return {"seed": seed, "segment": segment, "segments": segments, "prints": table.tobytes()}


def probe(keys: np.ndarray, seed: int, segment: int, segments: int, prints: bytes) -> np.ndarray:
    """Which keys the filter may hold."""
    keys = np.asarray(keys, np.uint64)
    if segments == 0:
        return np.zeros(len(keys), bool)
    table, s = np.frombuffer(prints, np.uint16), _slots(keys, seed, segment, segments)
    return (table[s[:, 0]] ^ table[s[:, 1]] ^ table[s[:, 2]]) == _prints(keys, seed)


def _keys(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in column), np.uint64)


def _bucket(n: int):
    """Bucket of a digest among ``n``: its first four bytes, scaled."""
    return (F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("bigint") * n / F.lit(2 ** 32)).cast("bigint")


def snapshot_filters(snapshot: DataFrame, buckets: int) -> DataFrame:
    """One filter per bucket of the distinct ``digest`` values."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"bucket": key[0]} | build_filter(_keys(pdf["digest"]))])

    return snapshot.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInPandas(
        build, "bucket bigint, seed bigint, segment bigint, segments bigint, prints binary")


def screen(incoming: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``digest`` of ``incoming`` (distinct) that a filter may hold."""
    def look(key: tuple, mine: pd.DataFrame, fuse: pd.DataFrame) -> pd.DataFrame:
        if not len(fuse) or not len(mine):
            return mine.iloc[:0][["digest"]]
        f = fuse.iloc[0]
        return mine.loc[probe(_keys(mine["digest"]), int(f.seed), int(f.segment), int(f.segments), f.prints), ["digest"]]

    keyed = incoming.select(_bucket(buckets).alias("bucket"), "digest")
    return keyed.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(look, "digest binary")


def exact_dedup(docs: DataFrame, in_snapshot=None) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept of every row of ``docs``.

    ``in_snapshot``: boolean column over ``docs`` naming the rows of the
    immutable snapshot; the others are the incoming batch (null: incoming;
    not given: the lower half of the range of doc_id is the snapshot). It
    decides the route only, never the result: of equal texts the row with
    the largest doc_id stays.

    Null text equals empty text. A null doc_id is smaller than any other.
    Rows that repeat both doc_id and text are rows of their own: they share
    keep_id, and one of them is kept. An empty table gives an empty result;
    other columns are not read.
    """
    base = with_fallback(docs, doc_id="bigint")
    if in_snapshot is None:
        middle = base.agg(((F.min("doc_id").cast("double") + F.max("doc_id").cast("double")) / 2).alias("m")).first()["m"]
        in_snapshot = F.col("doc_id") <= F.lit(middle)
    rows = written(digests(docs, in_snapshot).groupBy("digest", "doc_id", "in_snapshot").agg(F.count("*").alias("n")), "dedup-rows")

    def grouped(part: DataFrame) -> DataFrame:
        return part.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))

    old, new = grouped(rows.where("in_snapshot")), grouped(rows.where("not in_snapshot"))
    old = written(old, "dedup-snapshot")
    # Either side can be the larger one; the count of the incoming digests sets sizes only, so a sketch does.
    incoming = rows.where("not in_snapshot").agg(F.approx_count_distinct("digest").alias("n")).first()["n"]
    buckets = max(1, -(-max(old.count(), incoming) // BUCKET_KEYS))
    hits = written(screen(new, snapshot_filters(old, buckets), buckets), "dedup-hits")
    # Only the screened hits meet the exact buckets; of the rest, a group is what its own side holds.
    both = old.join(hits, "digest", "left_semi").unionByName(new)
    held = both.join(hits.select("digest", F.lit(True).alias("hit")), "digest", "left").where("hit").groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    groups = (old.join(hits, "digest", "left_anti").unionByName(new.join(hits, "digest", "left_anti")).unionByName(held))
    groups = written(groups, "dedup-groups")
    check_bytes(docs, groups.where("group_size > 1").select("digest"))
    first = rows.groupBy("digest", "doc_id").agg(F.sum("n").alias("n"))
    return (first.join(groups, "digest")
            .select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
            .select("doc_id", "digest", "keep_id", "group_size",
                    (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept")))


def with_digest(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the digest of its normalised text as column ``name``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column(name, pa.array([hashlib.sha256(t).digest() for t in normalised(b.column("text"))], pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def check_bytes(docs: DataFrame, repeated: DataFrame) -> None:
    """Compare the texts of each group in ``repeated`` (column digest) byte
    by byte; raise if two texts of one digest differ. Copies are spread over
    salts and reduced to their smallest and largest text per salt first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = normalised(b.column("text"))
            yield batch(TEXTS, doc_id=b.column("doc_id"), text=low, digest=[hashlib.sha256(t).digest() for t in low])

    texts = with_fallback(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, digest binary, text binary")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    wanted = repeated.select("digest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    spread = texts.select("digest", "text", salt).join(wanted, ["digest", "salt"], "left_semi")
    ends = spread.groupBy("digest", "salt").agg(F.min("text").alias("least"), F.max("text").alias("most"))
    ends = ends.groupBy("digest").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    if ends.where("least <> most").limit(1).count():
        raise ValueError("two different texts share a SHA-256 digest")
