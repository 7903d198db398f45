"""Each stage of the pipeline against a plain version, on its own input."""

import corpus_pipeline as P
import pytest
import test_ngram_join
import test_packing
from riskweave.llm import langid, pii
from riskweave.llm.frames import written


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    train = pii.train
    monkeypatch.setattr(pii, "train", lambda background: train(background, steps=25))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check_stages(spark, docs, sf_dir):
    columns = docs.columns
    named = [langid.has_letter(r["text"]) for r in docs.collect()]
    step = written(P.language_id(spark, docs, sf_dir), "test")
    assert step.columns == columns
    before, after = rows(docs), rows(step)
    assert set(after) <= {r for r in before if langid.has_letter(r[1])} and len(after) >= 0.8 * sum(named)

    before = rows(step)
    step = written(P.exact_copies(spark, step, sf_dir), "test")
    best = {}
    for r in before:
        key = (r[1] or "").translate({c: c + 32 for c in range(65, 91)})
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    assert step.columns == columns and {(r[0], r[1]) for r in rows(step)} == {(r[0], r[1]) for r in best.values()} and step.count() == len(best)

    before = rows(step)
    step = written(P.near_duplicates(spark, step, sf_dir), "test")
    classes = {(i, c) for i, c, _, _ in test_ngram_join.brute([(r[0], r[1]) for r in before])}
    assert step.columns == columns and {r[0] for r in rows(step)} == {i for i, c in classes if i == c}
    assert step.count() == len({r[0] for r in rows(step)})

    before = {r[0]: r for r in rows(step)}
    step = written(P.personal_data(spark, step, sf_dir), "test")
    assert step.columns == columns
    for r in rows(step):
        base = pii.base_spans(before[r[0]][1])
        assert not pii.base_spans(r[1]) and (base or r[1].count("<") >= before[r[0]][1].count("<"))
        if not any(c.isdigit() or c == "@" for c in before[r[0]][1]):
            assert r == before[r[0]]
    test_packing.check(P.packed(spark, step, sf_dir), step)


def test_stages_on_hard_rows(spark, hard):
    learn = spark.createDataFrame([(100 + 2 * k + n, f"{t} {k}", lang, "s", 5, *"dslxkcr") for k in range(12) for n, (t, lang) in enumerate(
                                   (("the cat and the dog WENT to 1234567890 a@b.c", "en"), ("der hund und die katze", "de")))], hard.schema)
    check_stages(spark, hard.unionByName(learn), "")


def test_stages_on_the_sample(spark, sample, small_sf):
    check_stages(spark, sample, small_sf)


def test_empty(spark, nothing):
    docs = nothing
    for _, stage in P.STAGES:
        docs = written(stage(spark, docs, ""), "test")
    assert docs.count() == 0
