"""Vector compression by product codes: active-entry Lloyd iterations.

A vector of integers is cut into PARTS equal consecutive parts; each part
position has a codebook of at most ENTRIES entries, and a part is coded by
the index of its nearest entry. The codebooks are found by Lloyd rounds over
all vectors. A part keeps the exact distance to its entry: if that entry
did not move in the last update, only the entries that moved can be nearer
and only they are compared (an entry that stayed was already no nearer, or
as near with a larger index); if it moved, the part is compared with all.

One job per round: each task assigns its vectors, writes them with their
codes and distances to the shared folder, and adds up one row of sums and
counts per part position and entry. Only these sums, combined by Spark,
reach the driver: PARTS x ENTRIES rows, whatever the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.frames import delete, stored, with_fallback

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
# Bound of an integer component: squared distances and their sums stay exact in 64 bits.
MOST = 1 << 24
# Rows that one numpy step handles.
STEP = 4096

STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())),
                   ("distances", pa.list_(pa.int64())), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
SCHEMA = ("vec_id bigint, label string, v array<bigint>, codes array<int>, distances array<bigint>, "
          "part int, entry int, n bigint, sums array<bigint>")


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component of the vectors
    that are not null and hold no null, NaN or infinity."""
    rows = with_fallback(vectors, vec_id="bigint", label="string", embedding="array<double>")
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    held = F.transform("embedding", lambda x: F.when(F.abs(x) <= F.lit(float(MOST) / scale), F.floor(x * F.lit(float(scale)))).cast("bigint"))
    return rows.where(F.col("embedding").isNotNull() & sound).select("vec_id", "label", held.alias("v"))


def assign(parts: np.ndarray, books: np.ndarray, moved: np.ndarray, codes: np.ndarray | None,
           distances: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its squared distance for ``parts`` (rows x width) of
    one position. ``moved`` marks the entries that differ from those behind
    ``codes`` and ``distances`` (None: no assignment yet)."""
    if codes is None:
        return full_scan(parts, books)
    codes, distances = codes.copy(), distances.copy()
    again = moved[codes]
    if again.any():
        codes[again], distances[again] = full_scan(parts[again], books)
    still = np.flatnonzero(~again)
    if len(still) and moved.any():
        near, mine = distances[still], codes[still]
        for e in np.flatnonzero(moved):
            d = ((parts[still] - books[e]) ** 2).sum(1)
            better = (d < near) | ((d == near) & (e < mine))
            near, mine = np.where(better, d, near), np.where(better, e, mine)
        codes[still], distances[still] = mine, near
    return codes, distances


def full_scan(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of all entries; the first of equally near ones."""
    d = np.stack([((parts - b) ** 2).sum(1) for b in books], 1)
    codes = d.argmin(1)
    return codes, d[np.arange(len(d)), codes]


def lloyd_round(rows: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """One assignment of all rows of ``rows`` to ``books`` (parts x entries x
    width): the rows with their new codes and distances, and per task and
    (part, entry) the count and the sums (part not null)."""
    positions, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((positions, entries), np.int64), np.zeros((positions, entries, width), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                some = b.slice(lo, STEP)
                n = some.num_rows
                v = padded(some.column("v"), positions * width)
                new = some.column("codes").null_count == n
                codes = None if new else some.column("codes").flatten().to_numpy().reshape(n, positions)
                distances = None if new else some.column("distances").flatten().to_numpy().reshape(n, positions)
                out = [assign(v[:, p * width:(p + 1) * width], books[p], moved[p], None if new else codes[:, p],
                              None if new else distances[:, p]) for p in range(positions)]
                for p, (mine, _) in enumerate(out):
                    counts[p] += np.bincount(mine, minlength=entries)
                    np.add.at(sums[p], mine, v[:, p * width:(p + 1) * width])
                yield rows_of(vec_id=some.column("vec_id"), label=some.column("label"), v=some.column("v"),
                              codes=list(np.stack([c for c, _ in out], 1).astype(np.int32)), distances=list(np.stack([d for _, d in out], 1)))
        p, e = np.nonzero(counts)
        yield rows_of(part=p.astype(np.int32), entry=e.astype(np.int32), n=counts[p, e], sums=list(sums[p, e]))

    return rows.select("vec_id", "label", "v", "codes", "distances").mapInArrow(run, SCHEMA)


def rows_of(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in STATE], schema=STATE)


def padded(column: pa.Array, dim: int) -> np.ndarray:
    """(rows x dim) of a list column; shorter lists end in zeros."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks whose entries are the floored means of their parts;
    entries without parts stay."""
    books = books.copy()
    sums = F.array(*[F.sum(F.col("sums")[k]) for k in range(books.shape[2])])
    for r in state.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():
        books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    return books


def compress(vectors: DataFrame, positions: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes, distances) of every row of ``vectors`` that takes
    part, and the codebooks (positions x entries x width) behind them.

    Components become floor(scale * x). Vectors that are null or hold null,
    NaN or infinite components take no part. Vectors shorter than the
    longest, or of a length that the positions do not divide, count as if
    zeros followed. Repeated rows are rows of their own. Codebooks start as
    the rows of the smallest vec_ids (a null one is the largest, rows of one
    vec_id by vector, then label); with fewer rows than entries there are as
    many entries. No rows: empty codebooks. A component beyond MOST in size
    raises, since distances would not be exact.
    """
    spark = vectors.sparkSession
    rows, kept = stored(integers(vectors, scale), "vectors")
    held = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.exists("v", lambda x: x.isNull())).alias("beyond")).first()
    if held["beyond"]:
        raise ValueError(f"components beyond {MOST} after scaling: distances would not be exact")
    width = -(-(held["dim"] or 0) // positions)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "label").select("v").limit(entries).collect()
    books = np.zeros((positions, len(first), width), np.int64)
    for e, r in enumerate(first):
        books[:, e] = np.array(r["v"] + [0] * (positions * width - len(r["v"])), np.int64).reshape(positions, width)
    state = rows.select("*", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("array<bigint>").alias("distances"))
    if not first:
        return state.drop("v"), books
    moved = np.ones(books.shape[:2], bool)
    for _ in range(rounds):
        out, path = stored(lloyd_round(state, books, moved), "assigned")
        after = updated(out, books)
        delete(spark, kept)  # only the last assignment is read again
        moved, books, state, kept = (after != books).any(2), after, out.where("part is null"), path
    last, _ = stored(lloyd_round(state, books, moved).where("part is null").select("vec_id", "label", "codes", "distances"), "codes")
    delete(spark, kept)
    return last, books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error (sum of the
    errors of all rows of a label, nulls together), codebooks_sha256."""
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    rows = coded.select("vec_id", "label", code.alias("code"), F.aggregate("distances", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("error"))
    total = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return rows.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
