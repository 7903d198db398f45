"""Hard-negative mining with exact integer scores by residue-number GEMM.

Scores are inner products of integer vectors. A block of anchors is
multiplied with a block of rows modulo several small primes, each product a
float32 matrix product of centred residues whose sums stay below 2^24 and
so are exact; Chinese remaindering gives back the signed score. How many
primes are needed follows from the largest component and length in the
table.

Rows are dealt into numbered blocks, one task each, and every block of
anchors (the stated queries) is sent to every block of rows: each task
holds its rows and streams the anchors past them. The first pass keeps the
best rows of the anchor's own label, the second the best rows of other
labels inside the window of each positive; both give at most a few rows
per anchor, positive and block, which a window merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.frames import batch, stored, with_fallback

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
# A negative's score lies between these percentages of the positive's.
LEAST, MOST = 80, 100
# Rows of a task and anchors of a block at most; rows of one matrix product.
BLOCK_ROWS, BLOCK_ANCHORS, STEP = 16384, 1024, 2048
# Scores stay below this, so that percentages of them fit in 64 bits.
BOUND = 1 << 55
# Components multiplied before residues are reduced again: 1024 * 125^2 < 2^24.
CHUNK = 1024


def primes(bound: int) -> list[int]:
    """The largest primes up to 251 (centred residues of at most 125) whose
    product exceeds 2 * ``bound``, the number of signed scores."""
    sieve = [p for p in range(2, 252) if all(p % q for q in range(2, int(p ** 0.5) + 1))]
    chosen, product = [], 1
    while product <= 2 * bound:
        chosen.append(sieve.pop())
        product *= chosen[-1]
    return chosen


def residues(v: np.ndarray, p: int) -> np.ndarray:
    """Components modulo ``p``, centred around zero, as float32."""
    r = v % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def scores(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``
    (integers), from products modulo each of ``moduli``."""
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in moduli:
        x, y = residues(a, p), residues(b, p)
        r = np.zeros((len(a), len(b)), np.int64)
        for lo in range(0, a.shape[1], CHUNK):
            r += (x[:, lo:lo + CHUNK] @ y[:, lo:lo + CHUNK].T).astype(np.int64)
        # Mixed radix: the next digit makes the value so far right modulo p too.
        value += product * ((r - value) % p * pow(product, -1, p) % p)
        product *= p
    return np.where(value > product // 2, value - product, value)


def first_of(s: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` largest allowed scores of every row of
    ``s``, the leftmost of equal ones first."""
    least = np.iinfo(np.int64).min
    left = np.where(allowed, s, least)
    every, rows, columns = np.arange(len(s)), [], []
    for _ in range(min(k, s.shape[1])):
        best = left.argmax(1)
        found = left[every, best] != least
        if not found.any():
            break
        rows.append(every[found])
        columns.append(best[found])
        left[every, best] = least
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *columns])


# --- blocks -------------------------------------------------------------------

BLOCKS = "block int, dim int, ids binary, labels binary, v binary, numbers binary, positives binary"
BLOCK_SCHEMA = pa.schema([("block", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
                          ("v", pa.binary()), ("numbers", pa.binary()), ("positives", pa.binary())])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v scaled and floored; a
    component out of bounds is null in it."""
    rows = with_fallback(vectors, vec_id="bigint", label="bigint", embedding="array<double>")
    sound = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform("embedding", lambda x: F.when(F.abs(x) < 2.0 ** 40, F.floor(x * float(SCALE))))
    kept = rows.where("vec_id is not null and label is not null and embedding is not null").where(sound)
    return kept.select("vec_id", "label", v.alias("v")).dropDuplicates(["vec_id", "label", "v"])


def score_bound(rows: DataFrame) -> int:
    """No score of two rows is larger in size; raises if exact scores would
    not fit in 64 bits."""
    top = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("top"),
                   F.max(F.exists("v", lambda x: x.isNull())).alias("beyond")).first()
    bound = (top["dim"] or 0) * (top["top"] or 0) ** 2
    if top["beyond"] or bound >= BOUND:
        raise ValueError("components are too large for scores in 64 bits")
    return max(1, bound)


def packed(rows: DataFrame, most: int, positives: int = 0) -> DataFrame:
    """The rows of each partition as binary blocks of one vector length and at
    most ``most`` rows, in the order of vec_id. ``block`` is the number of
    the partition. Columns ``number`` and ``positives`` (scores, best first)
    are carried if there; the latter as so many places and their count."""
    names = ["vec_id", "label", *[c for c in ("number", "positives") if c in rows.columns]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held: dict[int, list] = {}
        for b in batches:
            size = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                some = b.take(pa.array(np.flatnonzero(size == dim)))
                columns = {c: listed(some.column(c), positives) if c == "positives" else some.column(c).to_numpy() for c in names}
                columns["v"] = some.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, dim)
                held.setdefault(dim, []).append(columns)
                if sum(len(c["v"]) for c in held[dim]) >= most:
                    yield from flush(here, dim, held.pop(dim), most)
        for dim, parts in held.items():
            yield from flush(here, dim, parts, most)

    return rows.mapInArrow(run, BLOCKS)


def listed(column: pa.Array, places: int) -> np.ndarray:
    """(rows x places + 1): the lists' values, zeros, and their lengths."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), places + 1), np.int64)
    out[:, :places][np.arange(places)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    out[:, -1] = size
    return out


def flush(block: int, dim: int, parts: list, most: int) -> Iterator[pa.RecordBatch]:
    columns = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    order = np.argsort(columns["vec_id"], kind="stable")
    for lo in range(0, len(order), most):
        some = {k: [np.ascontiguousarray(c[order[lo:lo + most]]).tobytes()] for k, c in columns.items()}
        yield batch(BLOCK_SCHEMA, block=[block], dim=[dim], ids=some["vec_id"], labels=some["label"], v=some["v"],
                    numbers=some.get("number", [None]), positives=some.get("positives", [None]))


def unpacked(b: pa.RecordBatch, i: int) -> dict:
    out = {k: np.frombuffer(x, np.int64) for k in ("ids", "labels", "v", "numbers", "positives") if (x := b.column(k)[i].as_py()) is not None}
    return out | {"v": out["v"].reshape(len(out["ids"]), b.column("dim")[i].as_py())}


FOUND = pa.schema([("number", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def best(found: list[tuple], k: int) -> list[np.ndarray]:
    """The ``k`` first of each (number, place) among (number, place, vec_id,
    score) columns: higher scores, then smaller vec_ids."""
    number, place, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, -score, place, number))
    number, place, ids, score = number[order], place[order], ids[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], (number[1:] != number[:-1]) | (place[1:] != place[:-1])])[:len(number)])
    rank = np.arange(len(number)) - np.repeat(start, np.diff(np.append(start, len(number))))
    return [c[rank < k] for c in (number, place, ids, score)]


def met(blocks: DataFrame, number: int, anchors: DataFrame, compare, k: int) -> DataFrame:
    """(number, place, vec_id, score): the ``k`` first by ``compare`` of every
    block of anchors in every block of rows, merged over all. The ``number``
    blocks of rows are numbered from 0: a task receives its rows first, then
    the anchors, one block after the other."""
    sent = anchors.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    both = blocks.withColumn("second", F.lit(False)).unionByName(sent.withColumn("second", F.lit(True)).select(*blocks.columns, "second"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for i in range(b.num_rows):
                part = unpacked(b, i)
                if not b.column("second")[i].as_py():
                    rows.append(part)
                    continue
                found = [compare(part, {c: own[c][lo:lo + STEP] for c in ("ids", "labels", "v")})
                         for own in rows if own["v"].shape[1] == part["v"].shape[1] for lo in range(0, len(own["ids"]), STEP)]
                if found:
                    yield batch(FOUND, **dict(zip(FOUND.names, best(found, k))))

    found = both.repartitionById(number, "block").sortWithinPartitions("second").mapInArrow(
        run, "number bigint, place int, vec_id bigint, score bigint")
    order = Window.partitionBy("number", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- mining -------------------------------------------------------------------

def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         least: int = LEAST, most: int = MOST, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score: for each row of ``vectors`` (vec_id, label, embedding)
    for which ``is_anchor`` holds, its ``positives`` first other rows of its
    label, and for each of them the ``negatives`` first rows of other labels
    with least * positive_score <= 100 * negative_score <= most *
    positive_score. First is the higher score, then the smaller vec_id.

    The score is the integer inner product of floor(256 * x). Rows without
    vec_id, label or vector, or with a null, NaN or infinite component, take
    no part. Rows that repeat vec_id, label and vector count once; rows with
    the anchor's vec_id are not its others; different rows of one vec_id are
    anchors and candidates each. Vectors of different lengths are not
    compared; empty ones have score 0. A negative positive_score has no
    window. Components so large that scores would not fit in 64 bits raise.
    No rows, no result.
    """
    rows, _ = stored(usable(vectors), "vectors")
    count, moduli = rows.count(), primes(score_bound(rows))
    number = max(1, -(-count // block_rows), min(2 * vectors.sparkSession.sparkContext.defaultParallelism, count // 512))
    blocks, _ = stored(packed(rows.repartition(number), block_rows), "row-blocks")
    # The anchors, numbered: different rows of one vec_id are told apart.
    asked, _ = stored(rows.where(is_anchor).select(F.monotonically_increasing_id().alias("number"), "vec_id", "label", "v"), "anchors")
    tasks = max(1, -(-asked.count() // block_anchors))

    def own_label(a: dict, r: dict) -> tuple:
        s = scores(a["v"], r["v"], moduli)
        at, column = first_of(s, (a["labels"][:, None] == r["labels"]) & (a["ids"][:, None] != r["ids"]), positives)
        return a["numbers"][at], np.zeros(len(at), np.int32), r["ids"][column], s[at, column]

    anchors, _ = stored(packed(asked.repartition(tasks), block_anchors), "anchor-blocks")
    near, _ = stored(met(blocks, number, anchors, own_label, positives).select(
        "number", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    listed = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).getField("positive_score").alias("positives"))

    def in_windows(a: dict, r: dict) -> tuple:
        s = scores(a["v"], r["v"], moduli)
        limits = a["positives"].reshape(len(s), positives + 1)
        other, share = (a["labels"][:, None] != r["labels"]) & (a["ids"][:, None] != r["ids"]), 100 * s
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in range(positives):
            limit = limits[:, k, None]
            inside = other & (least * limit <= share) & (share <= most * limit) & (limits[:, -1:] > k)
            some = np.flatnonzero(inside.any(1))
            at, column = first_of(s[some], inside[some], negatives)
            out.append((a["numbers"][some[at]], np.full(len(at), k + 1, np.int32), r["ids"][column], s[some[at], column]))
        return tuple(np.concatenate(c) for c in zip(*out))

    limited, _ = stored(packed(asked.join(listed, "number").repartition(tasks), block_anchors, positives), "anchor-blocks")
    hard = met(blocks, number, limited, in_windows, negatives)
    known = near.join(asked.select("number", F.col("vec_id").alias("anchor_id")), "number")
    return hard.join(known, ["number", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
