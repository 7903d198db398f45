"""Quality scores by a factorisation machine.

A document is a sparse vector: its hashed words (counts, scaled to length
one), statistics of its structure in bins, and the bin of its n_chars. The
score is the logistic of bias + linear terms + all pairwise interactions,
whose weights are inner products of low-rank factors; the sum over pairs is
computed in linear time as half of (square of the sum - sum of the squares)
per factor. Trained with AdaGrad on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.frames import batch, spans, utf8, with_fallback
from riskweave.llm.words import word_hashes

WORD_BITS = 16
BINS = 16
FACTORS = 6
THRESHOLD = 0.3
# Bound of the training sample: labelled documents, none longer than TRAIN_CHARS.
TRAIN_DOCS, TRAIN_CHARS = 4000, 30_000
VISITS, BATCH = 24_000, 32  # documents seen in training, again and again if there are fewer

# Byte classes whose shares are statistics of a text.
CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "space": [9, 32],
    "line": [10, 13],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "mark": [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"],
    "wide": list(range(128, 256)),
}
STATISTICS = [*CLASSES, "bytes", "words", "word_length", "distinct", "repeated", "top_word", "n_chars"]
FEATURES = (1 << WORD_BITS) + len(STATISTICS) * BINS

RESULT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray   # (features,)
    factors: np.ndarray  # (features, FACTORS)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) entries, ordered by document."""
    n = len(offsets) - 1
    hashes, doc, size = word_hashes(data, offsets)
    words = np.bincount(doc, minlength=n)
    key = (doc << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    cell, count = np.unique(key, return_counts=True)
    cell_doc, cell_word = cell >> WORD_BITS, cell & ((1 << WORD_BITS) - 1)
    norm = np.sqrt(np.bincount(cell_doc, count.astype(float) ** 2, n))
    value = count / norm[cell_doc]

    length = np.diff(offsets)
    share, some = [], np.maximum(length, 1)
    for members in CLASSES.values():
        table = np.zeros(256, np.int32)
        table[members] = 1
        total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
        share.append(np.sqrt((total[offsets[1:]] - total[offsets[:-1]]) / some))
    many = np.maximum(words, 1)
    again = np.bincount(doc[1:][(hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, cell_doc, count)
    known = np.where(n_chars >= 0, np.log2(np.maximum(n_chars, 0) + 1) / 24, 0.999)
    stats = [*share, np.log2(length + 1) / 24, np.log2(words + 1) / 20, np.bincount(doc, size, n) / many / 16,
             np.bincount(cell_doc, minlength=n) / many, np.sqrt(again / many), np.sqrt(top / many), known]
    binned = np.stack([np.clip((s * BINS).astype(np.int64), 0, BINS - 1) + k * BINS for k, s in enumerate(stats)], 1) + (1 << WORD_BITS)
    every = np.repeat(np.arange(n), len(stats))
    docs = np.concatenate([cell_doc, every])
    order = np.argsort(docs, kind="stable")
    return docs[order], np.concatenate([cell_word, binned.ravel()])[order], np.concatenate([value, np.full(len(every), 0.5)])[order]


def raw_scores(m: Machine, doc: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Log-odds of each document; every document has entries."""
    if not len(doc):
        return np.zeros(0)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    xv = m.factors[feature] * value[:, None]
    total = np.add.reduceat(xv, first)
    pairs = 0.5 * (total ** 2 - np.add.reduceat(xv ** 2, first)).sum(1)
    return m.bias + np.add.reduceat(m.linear[feature] * value, first) + pairs


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(texts: list[str], n_chars: list, labels: list[int], visits: int = VISITS, seed: int = 5) -> Machine:
    """AdaGrad on the logistic loss in mini-batches."""
    rng = np.random.default_rng(seed)
    rate = float(np.mean(labels)) if labels else 0.5
    m = Machine(float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)))
    size_l, size_f = np.full(FEATURES, 1e-6), np.full((FEATURES, FACTORS), 1e-6)
    y = np.array(labels, float)
    column = pa.array(texts, pa.string())
    data, offsets = utf8(column)
    chars = np.array([-1 if c is None else c for c in n_chars], np.int64)
    parts = [features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], chars[i:j]) for i, j in spans(offsets)] if len(y) else []
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for doc, feature, value in parts:
        for f, v in zip(np.split(feature, np.flatnonzero(np.diff(doc)) + 1), np.split(value, np.flatnonzero(np.diff(doc)) + 1)):
            rows.append((f, v))
    for _ in range(-(-visits // max(1, len(rows))) if rows else 0):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo:lo + BATCH]
            doc = np.repeat(np.arange(len(chosen)), [len(rows[r][0]) for r in chosen])
            feature, value = (np.concatenate([rows[r][k] for r in chosen]) for k in (0, 1))
            g = (logistic(raw_scores(m, doc, feature, value)) - y[chosen]) / len(chosen)
            m.bias -= 0.5 * float(g.sum())
            xv = m.factors[feature] * value[:, None]
            total = np.add.reduceat(xv, np.flatnonzero(np.diff(doc, prepend=-1)))
            gv = (g[doc] * value)[:, None] * (total[doc] - xv)
            used, inverse = np.unique(feature, return_inverse=True)
            gl = np.bincount(inverse, g[doc] * value) + 1e-5 * m.linear[used]
            gf = np.stack([np.bincount(inverse, gv[:, k]) for k in range(FACTORS)], 1) + 1e-5 * m.factors[used]
            size_l[used] += gl ** 2
            size_f[used] += gf ** 2
            m.linear[used] -= 0.1 * gl / np.sqrt(size_l[used])
            m.factors[used] -= 0.03 * gf / np.sqrt(size_f[used])
    return m


def fit_on(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> Machine:
    """Machine of at most ``max_docs`` labelled documents (``labels``:
    doc_id, quality 0 or 1) for which ``learn`` holds, in the order of a
    hash of doc_id; of a longer text its first ``max_chars`` characters, of
    rows that repeat a doc_id the smallest. The bounds are on training only.
    Null labels do not teach."""
    rows = with_fallback(docs, doc_id="bigint", text="string", n_chars="bigint").where(learn).withColumn("text", F.substring("text", 1, max_chars))
    marked = with_fallback(labels, doc_id="bigint", quality="int").where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = rows.select("doc_id").distinct().join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    taught = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "n_chars", "quality")).alias("r"))
    got = [r["r"] for r in sorted(taught.collect(), key=lambda r: r["doc_id"])]
    return fit([r["text"] or "" for r in got], [r["n_chars"] for r in got], [r["quality"] for r in got])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1; higher: good) of every row of ``docs``.

    Only text and n_chars are read. A null text scores as the empty one,
    by its statistics alone; a null n_chars has a bin of its own. Repeated
    rows give repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            chars = b.column("n_chars").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            got = [raw_scores(shared.value, *features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], chars[i:j]))
                   for i, j in spans(offsets)]
            yield batch(RESULT, doc_id=b.column("doc_id"), score=logistic(np.concatenate([*got, np.zeros(0)])))

    return with_fallback(docs, doc_id="bigint", text="string", n_chars="bigint").mapInArrow(run, "doc_id bigint, score double")
