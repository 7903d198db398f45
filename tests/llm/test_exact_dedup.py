import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import exact_dedup as D


def brute(rows):
    low = {c: c + 32 for c in range(65, 91)}
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(low)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            kept = i == keep and first
            first = first and not kept
            out.append((i, keep, len(ids), kept, digest))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in df.collect()), key=str)


@pytest.mark.parametrize("side", [None, "all", "none", "odd"])
def test_equals_brute_force(hard, sample, side):
    where = {None: None, "all": F.lit(True), "none": F.lit(False), "odd": F.col("doc_id") % 2 == 1}[side]
    assert got(D.exact_dedup(hard, where)) == brute([(r["doc_id"], r["text"]) for r in hard.collect()])
    if side is None:
        assert got(D.exact_dedup(sample)) == brute([(r["doc_id"], r["text"]) for r in sample.collect()])


def test_empty(nothing):
    assert D.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 300, 5000])
def test_filter_has_no_misses_and_few_false_hits(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2 ** 63, n).astype(np.uint64)
    f = D.build_filter(np.concatenate([keys, keys]))
    assert D.probe(keys, **f).all()
    assert D.probe(rng.integers(0, 2 ** 63, 50_000).astype(np.uint64), **f).mean() < 3e-4


def test_screen_keeps_every_member(spark):
    digests = [(hashlib.sha256(str(k).encode()).digest(),) for k in range(2000)]
    snapshot, incoming = (spark.createDataFrame(part, "digest binary") for part in (digests[:1200], digests[1000:]))
    hits = {bytes(r["digest"]) for r in D.screen(incoming, D.snapshot_filters(snapshot, 3), 3).collect()}
    assert {d for d, in digests[1000:1200]} <= hits and len(hits) < 210


@pytest.mark.parametrize("side", ["none", "few"])
def test_incoming_groups_stay_small_beside_a_small_snapshot(spark, monkeypatch, side):
    rows = [(k, f"text {k % 450}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    largest, screen = [], D.screen

    def seen(incoming, filters, buckets):
        sizes = incoming.groupBy(D._bucket(buckets).alias("bucket")).count()
        largest.append(sizes.agg(F.max("count").alias("n")).first()["n"])
        return screen(incoming, filters, buckets)

    monkeypatch.setattr(D, "screen", seen)
    monkeypatch.setattr(D, "BUCKET_KEYS", 16)
    where = {"none": F.lit(False), "few": F.col("doc_id") < 3}[side]
    assert got(D.exact_dedup(docs, where)) == brute(rows)
    assert len(largest) == 1 and largest[0] <= 3 * 16
