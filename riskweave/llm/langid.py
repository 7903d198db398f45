"""Language identification by prediction by partial matching.

For every language a variable-order context tree over bytes is counted once
(orders 0 to 3) and frozen. The probability of a byte in a context is
count / (total + distinct) if it was seen there; otherwise the escape
probability distinct / (total + distinct) times the shorter context's
probability, renormalised over the bytes not seen. The code length of a
text is the sum of -log2 of these over all its bytes; the language with the
shortest code wins. The frozen code lengths are laid out as one table, so
that scoring a byte is one gather for all languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.frames import CHUNK_BYTES, batch, utf8, with_fallback

# Bound of the training sample: documents of each language, and characters from the start of each.
DOCS_PER_LANGUAGE = 400
MAX_CHARS = 20_000
# Bits per byte from which a text is rejected: what equally likely bytes take.
UNIFORM_BITS = 8.0
# Byte symbols with a class of their own; all rarer bytes share class 0.
MAX_SYMBOLS = 127
# A context of three bytes enters the tree if some language saw it so often.
MIN_CONTEXT = 4
UNDETERMINED = "und"

RESULT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


@dataclass
class PpmModel:
    """Frozen statistics: ``bits[row, language]``, where row is
    ``(a * A + b) * A + c`` for the last three symbols, or, if the three
    bytes before form a context of the tree, ``A**3 + context * A + c``."""
    languages: list[str]
    symbol: np.ndarray   # byte -> symbol
    context: np.ndarray  # three symbols -> context number, -1 if not in the tree
    bits: np.ndarray

    @property
    def size(self) -> int:
        return int(self.symbol.max()) + 1 if len(self.languages) else 1


def _refine(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Probabilities of the symbols (last axis) in contexts with ``counts``,
    escaping to ``shorter`` (same shape) for symbols not seen."""
    total, distinct = counts.sum(-1, keepdims=True), (counts > 0).sum(-1, keepdims=True)
    unseen = np.where(counts > 0, 0.0, shorter)
    rest = unseen.sum(-1, keepdims=True)
    closed = rest <= 0  # every symbol was seen: nothing to escape to
    seen = counts / np.maximum(total + np.where(closed, 0, distinct), 1)
    escape = np.where(closed, 0.0, distinct / np.maximum(total + distinct, 1)) / np.where(closed, 1.0, rest)
    return np.where(total > 0, seen + escape * unseen, shorter)


def fit(samples: list[tuple[str, str]]) -> PpmModel:
    """Count and freeze the trees from (language, text) samples."""
    languages = sorted({lang for lang, _ in samples})
    text = {lang: np.frombuffer(b"".join(b"\n\n\n" + t.encode() for at, t in samples if at == lang), np.uint8) for lang in languages}
    freq = sum((np.bincount(t, minlength=256) for t in text.values()), np.zeros(256, np.int64))
    common = [b for b in np.argsort(-freq, kind="stable")[:MAX_SYMBOLS] if freq[b]]
    symbol = np.zeros(256, np.int64)
    symbol[common] = np.arange(1, len(common) + 1)
    a, n_lang = len(common) + 1, len(languages)
    streams = {lang: symbol[t] for lang, t in text.items()}

    triples = np.zeros((n_lang, a ** 3), np.int32)
    for k, lang in enumerate(languages):
        s = streams[lang]
        triples[k] = np.bincount((s[:-2] * a + s[1:-1]) * a + s[2:], minlength=a ** 3)
    context = np.full(a ** 3, -1, np.int32)
    kept = np.flatnonzero(triples.max(0) >= MIN_CONTEXT) if n_lang else np.zeros(0, np.int64)
    context[kept] = np.arange(len(kept))

    bits = np.zeros((a ** 3 + len(kept) * a, n_lang), np.float32)
    for k, lang in enumerate(languages):
        s, c3 = streams[lang], triples[k].reshape(a, a, a).astype(np.float64)
        c2 = c3.sum(0)
        p0 = _refine(c2.sum(0), np.full(a, 1 / a))
        p1 = _refine(c2, np.broadcast_to(p0, (a, a)))
        p2 = _refine(c3, np.broadcast_to(p1, (a, a, a))).reshape(a * a, a)
        at = context[(s[:-3] * a + s[1:-2]) * a + s[2:-1]]
        hit = at >= 0
        c4 = np.bincount(at[hit] * np.int64(a) + s[3:][hit], minlength=len(kept) * a).reshape(len(kept), a)
        p3 = _refine(c4.astype(np.float64), p2[kept % (a * a)])
        bits[:, k] = -np.log2(np.concatenate([p2.ravel(), p3.ravel()]))
    bits[::a] += np.log2(256 - len(common))  # class 0: which of the rarer bytes it is
    return PpmModel(languages, symbol, context, bits)


def code_lengths(model: PpmModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact code length in bits of every document under every language."""
    a, n = model.size, len(offsets) - 1
    out = np.zeros((n, len(model.languages)))
    for lo in range(0, len(data), CHUNK_BYTES):  # slices of the bytes, with the three before them
        hi = min(len(data), lo + CHUNK_BYTES)
        s = np.full(hi - lo + 3, model.symbol[10], np.int32)
        head = max(0, lo - 3)
        s[3 - (lo - head):] = model.symbol[data[head:hi]]
        i, j = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        starts = np.maximum(offsets[i:j], lo) - lo
        c3, c2, c1, c0 = s[:-3].copy(), s[1:-2].copy(), s[2:-1].copy(), s[3:]
        newline = model.symbol[10]
        for back, column in ((3, c3), (2, c2), (1, c1)):  # a document starts after new lines
            for k in range(back):
                at = offsets[i:j] + k - lo
                column[at[(at >= 0) & (at < hi - lo) & (offsets[i:j] + k < offsets[i + 1:j + 1])]] = newline
        tree = model.context[(c3 * a + c2) * a + c1]
        row = np.where(tree >= 0, a ** 3 + tree * a, (c2 * a + c1) * a) + c0
        bits = model.bits[row]
        full = np.flatnonzero((offsets[i + 1:j + 1] > np.maximum(offsets[i:j], lo)))
        if len(full):
            out[i + full] += np.add.reduceat(bits, starts[full], axis=0, dtype=np.float64)
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(model: PpmModel, column: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
    """(language, score, bits per byte) of each text; the score is the
    winner's posterior under equal priors."""
    data, offsets = utf8(column)
    letters = np.array([has_letter(t) for t in column.to_pylist()], bool)
    if not model.languages:
        return [UNDETERMINED] * len(letters), np.zeros(len(letters)), np.zeros(len(letters))
    bits = code_lengths(model, data, offsets)
    best = bits.argmin(1)
    least = bits.min(1, keepdims=True)
    score = 1 / np.exp2(np.maximum(least - bits, -1000)).sum(1)
    per_byte = least[:, 0] / np.maximum(np.diff(offsets), 1)
    names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters)]
    return names, np.where(letters, score, 0.0), np.where(letters, per_byte, 0.0)


def training_sample(docs: DataFrame, learn: Column, per_language: int = DOCS_PER_LANGUAGE,
                    max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_language`` documents of each non-null
    lang, in the order of a hash of doc_id (without one: of the text); the
    bound is on training only. Rows that repeat lang and doc_id are one
    document, of which the smallest text counts. Of a text longer than
    ``max_chars`` its first ``max_chars`` characters are taken."""
    rows = with_fallback(docs, doc_id="bigint", text="string", lang="string").where(
        learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("lang", F.substring("text", 1, max_chars).alias("text"), F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("key"))
    # A hash threshold per language leaves about three times the bound, whatever the number of rows.
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("n"))
    draw = F.pmod("key", F.lit(1 << 40)) / F.lit(float(1 << 40))
    drawn = rows.select("lang", "key").join(F.broadcast(sizes), "lang").where(draw * F.col("n") <= 3 * per_language + 50)
    order = Window.partitionBy("lang").orderBy(draw, "key")
    chosen = drawn.select("lang", "key").distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_language)
    picked = rows.join(F.broadcast(chosen.select("lang", "key")), ["lang", "key"], "left_semi")
    return sorted((r["lang"], r["text"]) for r in picked.groupBy("lang", "key").agg(F.min("text").alias("text")).collect())


def remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor`` (null doc_id: 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


def fit_on(docs: DataFrame) -> PpmModel:
    """Model of the documents whose remainder modulo 3 is not 1."""
    return fit(training_sample(docs, remainder(3) != 1))


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte for every row of ``docs``.

    Only the text is read. A null text, or one without a letter (also the
    empty one), gives `und`, score 0. Equal code lengths: the language
    first in alphabetical order. Repeated rows give repeated results; an
    empty table gives none. A model without any language gives `und`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score, bits = predict(shared.value, b.column("text"))
            yield batch(RESULT, doc_id=b.column("doc_id"), lang_pred=names, score=score, bits_per_byte=bits)

    return with_fallback(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, bits_per_byte double")


def keep_identified(docs: DataFrame, model: PpmModel) -> DataFrame:
    """The rows of ``docs``, all columns, without those that the language
    identification rejects: no letters (or null), or a text that no
    language's tree codes shorter than equally likely bytes would be. A model
    without any language can reject only the texts without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not shared.value.languages:
                yield b.filter(pa.array([has_letter(t) for t in b.column("text").to_pylist()], pa.bool_()))
                continue
            names, _, bits = predict(shared.value, b.column("text"))
            keep = np.array([n != UNDETERMINED for n in names], bool) & (bits < UNIFORM_BITS)
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
