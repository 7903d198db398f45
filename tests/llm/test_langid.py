import zlib
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from riskweave.llm import langid

EN = "the cat and the other dog went over there and then they came back to the house with her"
DE = "der hund und die katze gehen nach hause und dann kommen sie wieder zurück zu der schönen straße"


def brute_bits(samples, lang, text, symbols, kept):
    """Code length by plain recursion over counted contexts."""
    counts = defaultdict(Counter)
    stream = [symbols[b] for at, t in samples if at == lang for b in b"\n\n\n" + t.encode()]
    for k in range(len(stream)):
        for order in (0, 1, 2):
            if k >= 2:
                counts[tuple(stream[k - order:k])][stream[k]] += 1
        if k >= 3 and tuple(stream[k - 3:k]) in kept:
            counts[tuple(stream[k - 3:k])][stream[k]] += 1
    a = max(symbols.values()) + 1

    def p(context, s):
        if context is None:
            return 1 / a
        shorter = context[1:] if context else None
        c = counts.get(context)
        if not c:
            return p(shorter, s)
        if len(c) == a:
            return c[s] / c.total()
        if s in c:
            return c[s] / (c.total() + len(c))
        rest = sum(p(shorter, x) for x in range(a) if x not in c)
        return len(c) / (c.total() + len(c)) * p(shorter, s) / rest

    history = [symbols[10]] * 3
    total = 0.0
    for b in text.encode():
        s = symbols[b]
        context = tuple(history[-3:])
        total -= log2(p(context if context in kept else context[1:], s))
        total += log2(256 - (a - 1)) if s == 0 else 0
        history.append(s)
    return total


def test_code_lengths_equal_plain_recursion():
    samples = [("de", "der die das und"), ("de", "die der"), ("en", "the and the of the"), ("en", "and then")]
    model = langid.fit(samples)
    symbols = {b: int(model.symbol[b]) for b in range(256)}
    a = model.size
    kept = {(k // a // a, k // a % a, k % a) for k in np.flatnonzero(model.context >= 0).tolist()}
    assert kept
    texts = ["the der", "xyz and", "t", ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = langid.code_lengths(model, data, offsets)
    for n, t in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert abs(got[n, k] - brute_bits(samples, lang, t, symbols, kept)) < 1e-3


def test_probabilities_sum_to_one():
    model = langid.fit([("de", DE), ("en", EN)])
    p = np.exp2(-model.bits.astype(float))
    p[::model.size] *= 256 - (model.size - 1)
    assert np.allclose(p.reshape(-1, model.size, 2).sum(1), 1, atol=1e-4)


def test_slices_do_not_change_code_lengths(monkeypatch):
    model = langid.fit([("de", DE), ("en", EN)])
    text = (EN + DE) * 20
    column = pa.array([text, "", EN, "x"])
    whole = langid.predict(model, column)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 101)
    cut = langid.predict(model, column)
    assert whole[0] == cut[0] and np.allclose(whole[2], cut[2])


def test_hard_rows(hard, nothing):
    model = langid.fit([("de", DE), ("en", EN)])
    rows = langid.identify(hard, model).collect()
    assert len(rows) == hard.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["lang_pred"] == "en" and by[2]["lang_pred"] == "de"
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (3, 4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert langid.identify(nothing, model).count() == 0
    assert langid.fit_on(nothing).languages == []
    assert set(r["lang_pred"] for r in langid.identify(hard, langid.fit([])).collect()) == {"und"}
    model = langid.fit([("de", DE), ("en", EN), ("en", EN.upper()), ("en", "mail anna@some.org on 1.2.3.4 or 0123456789 " * 2)])
    kept = langid.keep_identified(hard, model)
    assert kept.columns == hard.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 9, 10, 12}
    assert not {r["doc_id"] for r in kept.collect()} & {3, 4, 5, 6}


def test_held_out_accuracy(sample):
    found = langid.identify(sample, langid.fit_on(sample)).join(sample.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"] and r["lang_pred"] != "und"]
    assert len(held) > 30 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_sample_holds_every_language_and_one_row_per_document(spark):
    rows = [(k, f"l{lang}", f"text {lang} {k}") for lang in range(100) for k in range(3)]
    docs = spark.createDataFrame(rows * 2 + [(7, "twice", t) for t in "bca"], "doc_id bigint, lang string, text string")
    sample = langid.training_sample(docs, F.lit(True), per_language=2)
    assert {lang: sum(at == lang for at, _ in sample) for lang, _ in sample} == {f"l{k}": 2 for k in range(100)} | {"twice": 1}
    assert len(set(sample)) == 201 and ("twice", "a") in sample


def test_sample_holds_documents_without_an_id(spark):
    docs = spark.createDataFrame([(None, "en", f"text {k}") for k in range(5)] + [(1, "en", "one")], "doc_id bigint, lang string, text string")
    assert len(langid.training_sample(docs, F.lit(True), per_language=6)) == 6
    assert len(langid.training_sample(docs, F.lit(True), per_language=4)) == 4


def test_long_documents_are_learned_from_their_start(spark):
    docs = spark.createDataFrame([(1, "en", EN * 400), (2, "de", DE)], "doc_id bigint, lang string, text string")
    sample = dict(langid.training_sample(docs, F.lit(True)))
    assert sample == {"en": (EN * 400)[:langid.MAX_CHARS], "de": DE}
    assert len(sample["en"]) < len(EN * 400)


def test_without_any_language_texts_with_letters_stay(hard):
    kept = langid.keep_identified(hard, langid.fit([]))
    assert kept.columns == hard.columns
    want = sorted((r["doc_id"] for r in hard.collect() if langid.has_letter(r["text"])), key=str)
    assert want and sorted((r["doc_id"] for r in kept.collect()), key=str) == want
