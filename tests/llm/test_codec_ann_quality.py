import random
import zlib

import numpy as np
import pytest

from riskweave.llm import ann, piece_codec, quality
from riskweave.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


# --- piece codec -------------------------------------------------------------

@pytest.fixture(scope="module")
def reference():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_equal_the_library(sample, reference):
    rng, c = random.Random(1), piece_codec.codec(PATH)
    texts = [r["text"] or "" for r in sample.collect()]
    texts += ["".join(rng.choices("abcdeé  \n\t.,<>ß日①x0\u0301'\"thionger", k=rng.randint(0, 60))) for _ in range(1500)]
    texts += [" " * n + "x" * m for n in range(40) for m in (0, 1, 30)] + ["the" * 200, "=" * 90, "ab" * 300]
    texts += ["".join(rng.choices([p.replace("▁", " ") for p in c.pieces[259:]], k=10)) for _ in range(1500)]
    got = c.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == reference.encode(texts)
    assert [c.decode(x) for x in got] == texts
    assert c.decode(np.array([3 + 0xE6, 3 + 0x97], "<u4").tobytes()) == "\ufffd"


def test_long_text_without_spaces(reference, monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choices("abcdefgétion日", k=60_000))
    monkeypatch.setattr(piece_codec, "CELLS", 7000)  # many windows of ends
    got = piece_codec.PieceCodec(PATH).encode([text, text[:9000], text[:9000] + "x"])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == reference.encode([text, text[:9000], text[:9000] + "x"])


def test_memory_bound_changes_nothing(sample, monkeypatch):
    texts = [r["text"] or "" for r in sample.collect()][:60]
    want = piece_codec.codec(PATH).encode(texts)
    monkeypatch.setattr(piece_codec, "WORDS", 50)
    small = piece_codec.PieceCodec(PATH)
    assert [x for t in texts for x in small.encode([t])] == want


def test_codec_hard_rows(hard, nothing, reference):
    rows = piece_codec.digest_documents(hard, PATH).collect()
    for r, t in zip(rows, [r["text"] or "" for r in hard.collect()]):
        ids = np.array(reference.encode(t), "<u4").tobytes()
        assert (r["n_ids"], r["ids_crc32"], r["round_trip"]) == (len(ids) // 4, zlib.crc32(ids), True)
    assert piece_codec.digest_documents(nothing, PATH).count() == 0
    assert [r["decoded"] for r in piece_codec.encode_documents(hard, PATH).collect()] == [r["text"] or "" for r in hard.collect()]


# --- nearest neighbours ------------------------------------------------------

def plain_nearest(rows, queries, k=5):
    sound = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in sound:
        if i in queries:
            best = {}
            for j, v in sound:
                if j != i and len(v) == len(q):
                    a, b = q / np.abs(q).max(), v / np.abs(v).max()
                    s = float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
                    best[j] = max(s, best.get(j, -2))
            out[i] = sorted(((-round(s, 12), j) for j, s in best.items()))[:k]
    return out


def vectors(n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=d).tolist()) for k in range(n)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)]                      # one vector many times
    rows += [(2000, None), (2001, []), (2002, [0.0] * d), (2003, [None] + [1.0] * (d - 1)), (2004, [float("nan")] * d),
             (2005, [float("inf")] + [1.0] * (d - 1)), (None, [1.0] * d), (2010, [1.0, 2.0]), (2020, [3.0, 1.0]), (50, rows[50][1]),
             (2030, [1e200] * d), (2050, (2 * np.array(rows[0][1])).tolist())]
    return rows


@pytest.mark.parametrize("shard_rows, block_rows", [(10_000, 10_000), (50, 7)])
def test_nearest_equals_brute_force(spark, monkeypatch, shard_rows, block_rows):
    from pyspark.sql import functions as F
    monkeypatch.setattr(ann, "LEAF_ROWS", 6)
    rows = vectors()
    df = spark.createDataFrame([(i, v, "x", 1, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, label string, rank int, score double")
    got = ann.nearest(df, F.col("vec_id") % 10 == 0, shard_rows=shard_rows, block_rows=block_rows).collect()
    want = plain_nearest(rows, {i for i, _ in rows if i is not None and i % 10 == 0})
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
    assert found == {q: w for q, w in want.items() if w}


def test_many_ties_are_all_kept(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(9)
    v = rng.normal(size=12)
    rows = [(k, (v * rng.uniform(0.1, 9)).tolist()) for k in range(900)]  # different vectors of one direction
    rows += [(5000 + k, rng.normal(size=12).tolist()) for k in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), w) for i, w in rows], "vec_id bigint, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=150).collect()
    want = plain_nearest([(int(i), w) for i, w in rows], {int(i) for i, _ in rows if i % 100 == 0})
    for q, best in want.items():
        mine = sorted((r["rank"], round(r["score"], 12), r["vec_id"]) for r in got if r["query_id"] == q)
        assert [s for _, s, _ in mine] == [-s for s, _ in best]
        if q >= 5000:
            assert [i for _, _, i in mine] == [i for _, i in best]


def test_shards_that_cannot_help_are_skipped(spark, monkeypatch):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16)) * 10
    rows = [(k, (centres[k % 8] + rng.normal(size=16) * 0.05).tolist()) for k in range(1600)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    sent = []
    plain = ann.searched
    monkeypatch.setattr(ann, "searched", lambda trees, asked, *rest: sent.append(asked.count()) or plain(trees, asked, *rest))
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=100).collect()
    queries, shards = 80, 16
    assert sent[0] == queries and sent[1] < queries * shards / 3
    want = plain_nearest(rows, {k for k in range(1600) if k % 20 == 0})
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
    assert found == want


def test_relaxed_pruning_still_finds_most():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 6))
    tree = ann.build(np.arange(3000), v)
    exact, loose = (ann.search(tree, np.arange(100), v[:100], 5, relax) for relax in (1.0, 1.3))
    u = ann.unit(v)
    c = u[:100] @ u.T
    c[np.arange(100), np.arange(100)] = -2
    assert (np.sort(exact.number, 1) == np.sort(np.argsort(-c, 1)[:, :5], 1)).all()
    assert np.mean([len(set(a) & set(b)) for a, b in zip(exact.number.tolist(), loose.number.tolist())]) >= 4.5


def test_nearest_empty(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert ann.nearest(df, F.lit(True)).count() == 0


# --- quality -----------------------------------------------------------------

def test_linear_time_pairs_equal_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 3)))
    doc = np.array([0, 0, 0, 1, 1])
    feature, value = rng.integers(0, quality.FEATURES, 5), rng.normal(size=5)
    got = quality.raw_scores(m, doc, feature, value)
    for d in (0, 1):
        at = np.flatnonzero(doc == d)
        pairs = sum(m.factors[feature[a]] @ m.factors[feature[b]] * value[a] * value[b] for a in at for b in at if a < b)
        assert abs(got[d] - (0.3 + m.linear[feature[at]] @ value[at] + pairs)) < 1e-9


def test_quality_hard_rows(hard, nothing):
    m = quality.fit(["good words that are said here"] * 20 + ["BAD!! BAD!! $$$ ###"] * 20, [None, 5] * 20, [1] * 20 + [0] * 20, visits=200)
    rows = quality.score(hard, m).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert len(by[10]) == 1 and len(by[3]) == 1
    assert quality.score(nothing, m).count() == 0
    assert quality.score(hard, quality.fit([], [], [])).count() == hard.count()


def test_long_documents_teach_and_repeats_count_once(spark):
    from pyspark.sql import functions as F
    rows = [(k, ("good words said here " if k % 2 else "BAD!! $$$ ### ") * 3000, None) for k in range(30) for _ in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, quality int")
    m = quality.fit_on(docs, labels, F.lit(True), max_docs=20)
    scored = {r["doc_id"]: r["score"] for r in quality.score(docs, m).collect()}
    assert min(s for k, s in scored.items() if k % 2) > max(s for k, s in scored.items() if not k % 2)


def test_held_out_quality(spark, small_sf):
    from riskweave.llm.langid import remainder
    docs, labels = (spark.read.parquet(f"{small_sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(docs, quality.fit_on(docs, labels, remainder(5) != 0)).withColumn("held", remainder(5) == 0)
    rows = scored.join(labels, "doc_id").where("held").collect()
    assert sum((r["score"] >= quality.THRESHOLD) == bool(r["quality"]) for r in rows) >= 0.93 * len(rows)
