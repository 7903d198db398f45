"""Packing of tokenised documents into as few fixed-length sequences as possible.

Documents longer than a sequence are cut; only the number of pieces of each
length (at most 1024 numbers) goes to the driver, whatever the size of the
corpus. There a linear grouping scheme plans the sequences:

1. the large lengths are rounded up within groups of about equal numbers of
   pieces;
2. the few sizes left are packed by configurations: a linear program solved
   by column generation, rounded down to whole sequences;
3. the pieces themselves take the places, each of its own length;
4. what is left over and all small pieces go, longest first, where they fit
   best.

The plan is a short list of runs (length, range of ranks -> sequences,
offset); a task finds a piece's place from its rank among the pieces of its
length. Ranks are numbered within salts, so that a length that a third of
all pieces share is not one group.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.frames import batch, with_fallback, written

CAPACITY = 1024
END_ID = 2
# Lengths above this share of a sequence are large.
LARGE_SHARE = 1 / 8
GROUPS = 128
# Pieces that one ranking group holds on average.
ROWS_PER_SALT = 20_000
# Pre-tokens that a task remembers; it forgets them all when there are more.
CACHE = 400_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])


# --- tokens ----------------------------------------------------------------

# Fixed value: the split of the byte-level vocabulary into pre-tokens, for
# texts of tab, line feeds, ASCII and Latin characters (whose letters are LETTERS).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
PRE_TOKEN = re.compile(rf" ?[{LETTERS}]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\t\n\r -~\u00a0-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u024f]")
# A space before these does not begin a pre-token.
ODD_SPACES = ("  ", " \n", " \t", " \r", " \u00a0")


class TokenCoder(dict):
    """Text between two spaces -> ids of a space and this text, as
    little-endian 32-bit bytes, remembered: a space before a visible
    character begins a pre-token, whatever stands before it."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # Special strings are matched in the raw text, before the split.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # One pre-token is merged by rank; ids are ranks in such a vocabulary.
        ranks = {bytes(BYTE_OF[c] for c in token): k for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if token not in self.special}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def split(self, text: str) -> bytes:
        merge = self.merge
        return np.array([k for t in PRE_TOKEN.findall(text) for k in merge(t.encode())], "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        ids = self[chunk] = self.split(" " + chunk)
        return ids

    def ids(self, text: str) -> bytes:
        """The ids that the tokenizer gives the whole text, as bytes."""
        if UNUSUAL.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        if text.endswith(" ") or any(s in text for s in ODD_SPACES):
            return self.split(text)
        first, *rest = text.split(" ")
        return self.split(first) + b"".join(map(self.__getitem__, rest))


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand
    for themselves, the others for the characters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


BYTE_OF = _byte_alphabet()
_coders: dict[str, TokenCoder] = {}


def coder(path: str) -> TokenCoder:
    """One coder per path and Python process."""
    if path not in _coders:
        _coders[path] = TokenCoder(path)
    return _coders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first may be short."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = code.ids(text or "") + end
                rows += [(doc_id, k, s, n, zlib.crc32(ids[4 * s:4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield batch(PIECES, **{f.name: [r[k] for r in rows] for k, f in enumerate(PIECES)})

    return with_fallback(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


# --- plan ------------------------------------------------------------------

@dataclass
class Run:
    """The pieces of one length with ranks from ``rank`` on: ``each`` go into
    every sequence from ``sequence`` on, behind each other from ``offset``."""
    length: int
    rank: int
    count: int
    sequence: int
    offset: int
    each: int


def grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """length -> rounded-up length, in groups of about equal cardinality."""
    lengths, total = sorted(counts), sum(counts.values())
    at, seen = {}, 0
    for n in lengths:
        at[n] = int((seen + counts[n] / 2) * groups / total)
        seen += counts[n]
    top = {g: max(n for n in lengths if at[n] == g) for g in set(at.values())}
    return {n: top[at[n]] for n in lengths}


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size that fit ``capacity`` with the largest value:
    one round of the knapsack recursion per piece of the configuration."""
    back = np.arange(capacity + 1)[None, :] - sizes[:, None]
    best, choices = np.zeros(capacity + 1), []
    for _ in range(capacity // int(sizes.min())):
        gain = np.where(back >= 0, best[np.maximum(back, 0)] + values[:, None], -np.inf)
        pick = gain.argmax(0)
        top = gain[pick, np.arange(capacity + 1)]
        better = top > best + 1e-12
        if not better.any():
            break
        choices.append(np.where(better, pick, -1))
        best = np.where(better, top, best)
    out, room = np.zeros(len(sizes)), capacity
    for pick in reversed(choices):
        if pick[room] >= 0:
            out[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return out


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, steps: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(configurations as columns, how often each is used), the linear
    optimum by column generation; stops early after ``steps`` columns, with a
    feasible solution that is then only less tight."""
    base = np.diag(np.floor(capacity / sizes))
    x = need / base.diagonal()
    for _ in range(steps):
        value = np.linalg.solve(base.T, np.ones(len(sizes)))
        column = best_configuration(sizes, np.maximum(value, 0), capacity)
        if column @ np.maximum(value, 0) <= 1 + 1e-9:
            break
        move = np.linalg.solve(base, column)
        up = move > 1e-9
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = max(ratio[out], 0)
        base[:, out] = column
    return base, x


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[Run]:
    """Runs that place every piece; ``counts``: length -> number of pieces."""
    runs: list[Run] = []
    rank = defaultdict(int)
    left = {n: c for n, c in counts.items() if c > 0}
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> (first sequence, count)
    following = 0

    def put(length: int, count: int, sequence: int, offset: int, each: int = 1) -> None:
        runs.append(Run(length, rank[length], count, sequence, offset, each))
        rank[length] += count
        left[length] -= count

    large = {n: c for n, c in left.items() if capacity * LARGE_SHARE < n < capacity}
    if large:
        rounded = grouped(large, groups)
        sizes = np.array(sorted(set(rounded.values())))
        members = {s: sorted((n for n in large if rounded[n] == s), reverse=True) for s in sizes.tolist()}
        longest = sorted(large, reverse=True)
        need = np.array([sum(large[n] for n in members[s]) for s in sizes.tolist()], float)
        base, times = configurations(sizes, need, capacity)
        for k in np.argsort(-times, kind="stable"):
            bins = [(following, int(times[k] + 1e-6), 0)] if times[k] >= 1 - 1e-6 else []
            following += int(times[k] + 1e-6)
            slots = [s for s, n in zip(sizes.tolist(), base[:, k]) for _ in range(int(round(n)))]
            for place, size in enumerate(sorted(slots, reverse=True), 1):  # the documents themselves take the places
                after = []
                for first, count, used in bins:
                    # The last place of a sequence also takes the room that rounding up had left.
                    for n in members[size] if place < len(slots) else [n for n in longest if n <= capacity - used]:
                        take = min(count, left[n])
                        if take:
                            put(n, take, first, used)
                            after.append((first, take, used + n))
                            first, count = first + take, count - take
                    if count:
                        after.append((first, count, used))
                bins = after
            for first, count, used in bins:
                rooms[capacity - used].append((first, count))
    for n in sorted(left, reverse=True):  # best fit, longest first
        while left[n]:
            room = next((r for r in range(n, capacity) if rooms[r]), capacity)
            each = room // n
            if room == capacity and not rooms[capacity]:
                need_bins = -(-left[n] // each)
                rooms[capacity].append((following, need_bins))
                following += need_bins
            first, count = rooms[room].pop()
            full = min(count, left[n] // each)
            if full:
                put(n, full * each, first, capacity - room, each)
                rooms[room - each * n].append((first, full))
                first, count = first + full, count - full
            if count and 0 < left[n] < each:
                last = left[n]
                put(n, last, first, capacity - room, last)
                rooms[room - last * n].append((first, 1))
                first, count = first + 1, count - 1
            if count:
                rooms[room].append((first, count))
    return runs


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece.

    Every row is a document: its ids (null text: none), then ``end_id``.
    Rows that repeat a doc_id, or have none, are packed on their own. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    cuts = written(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    total = cuts.count()
    salts = max(16, -(-total // ROWS_PER_SALT))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = written(cuts.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-counts")
    # At most `capacity` rows.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = sorted(plan(histogram, capacity), key=lambda r: (r.length, r.rank))
    shared = spark.sparkContext.broadcast(np.array([(r.length, r.rank, r.count, r.sequence, r.offset, r.each) for r in runs], np.int64).reshape(-1, 6))

    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (cuts.withColumn("place", F.row_number().over(order) - 1).join(shift, ["length", "salt"])
              .withColumn("rank", F.col("shift") + F.col("place")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = p[:, 0] * (1 << 48) + p[:, 1]
        for b in batches:
            length, at = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = p[np.searchsorted(keys, length * (1 << 48) + at, "right") - 1] if len(length) else p[:0]
            j = at - r[:, 1]
            yield batch(PLACED, **{f.name: b.column(f.name) for f in PIECES},
                        sequence_id=r[:, 3] + j // np.maximum(r[:, 5], 1), offset=r[:, 4] + j % np.maximum(r[:, 5], 1) * length)

    return ranked.select(*[f.name for f in PIECES], "rank").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
