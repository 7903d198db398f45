"""WARC archives: round trip, determinism, rolling, commit, damage."""

import gzip
import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from riskweave.llm import warc
from riskweave.llm.warc import LARGEST, Bounds
from riskweave.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, shard string, page string, bits string, digest string, payload string, mark string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "p", "b", "d", "x", "m") for r in rows], SCHEMA)


def pages(seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows = [(i, f"https://h{i % 9}.org/p {i}\né", " ".join(rng.choices(words, k=rng.randint(1, 400)))) for i in range(300)]
    same = "the same page many times over " * 9
    rows += [(i, None, same) for i in range(900, 400, -1)]       # a hot group of copies
    rows += [(1000 + i, "", "short") for i in range(20)]         # too short to revisit
    rows += [(77_000, f"u{i}", " ".join(rng.choices(words, k=60))) for i in range(200)]  # a hot page_id
    rows += [(2000, "b", same), (2000, "b", same), (2001, None, None), (2002, None, ""), (None, "n", same), (None, "n", "only here " * 30),
             (2003, "x", "r\r\n\r\nWARC/1.1\r\n \x00 \U0001F600 " * 20), (-5, "neg", "long " * 60_000), (-LARGEST, "e", "ends " * 40), (LARGEST - 1, "e", "ends " * 41),
             (3001, "q", "twice in a row " * 12), (3001, "q", "twice in a row " * 12)]
    rng.shuffle(rows)
    return rows


def plain(rows, least=100):
    """(page_id, bytes, digest, type, refers_to) of every row."""
    groups, out = defaultdict(list), []
    for page_id, url, html in rows:
        payload = (html or "").encode()
        groups[payload].append((page_id is None, page_id, url is not None, url))
    for payload, some in groups.items():
        digest = hashlib.sha256(payload).hexdigest()
        for k, (_, page_id, _, _) in enumerate(sorted(some, key=lambda x: (x[0], x[1] or 0, x[2], x[3] or ""))):
            revisit = k > 0 and len(payload) >= least
            out.append((page_id, len(payload), digest, "revisit" if revisit else "response", min(some, key=lambda x: (x[0], x[1] or 0))[1] if revisit else None))
    return sorted(out, key=str)


def got(spark, path):
    found = warc.resolved(warc.read_archive(spark, path)).collect()
    return sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found], key=str), found


def files_of(path):
    return {n: hashlib.sha256(open(f"{path}/{n}", "rb").read()).hexdigest() for n in os.listdir(path) if n.endswith(".warc.gz")}


def local(spark, name):
    return scratch_path(spark, name).removeprefix("file:")


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 60_000, "roll_bytes": 9_000}])
def test_round_trip(spark, sizes):
    rows, path = pages(), local(spark, "archive")
    warc.write_archive(frame(spark, rows).repartition(5), path, **sizes)
    have, found = got(spark, path)
    assert have == plain(rows)
    texts = {(r["page_id"], r["payload_digest"]): r["payload"] for r in found if r["record_type"] == "response"}
    for page_id, _, html in rows:
        payload = (html or "").encode()
        if (held := texts.get((page_id, hashlib.sha256(payload).hexdigest()))) is not None:
            assert bytes(held) == payload
    assert all(r["payload"] is None for r in found if r["record_type"] == "revisit")
    assert len({r["record_id"] for r in found}) == len(found)
    assert not os.path.exists(f"{path}/_temporary") and not os.path.exists(f"{path}/_manifest")
    assert sum(r["records"] for r in spark.read.parquet(f"{path}/manifest").collect()) == len(rows)
    if sizes:
        names = sorted(files_of(path))
        assert len({n.split("-")[1] for n in names}) > 5 and any(n.endswith("00001.warc.gz") for n in names)


def test_same_pages_give_the_same_files(spark):
    rows, archives = pages(2), []
    for parts in (1, 7):
        path = local(spark, "archive")
        df = frame(spark, rows).repartition(parts) if parts > 1 else frame(spark, rows[::-1]).coalesce(1)
        archives.append(files_of(warc.write_archive(df, path, shard_bytes=60_000, roll_bytes=9_000)))
    assert archives[0] == archives[1] and len(archives[0]) > 10


def test_records_are_plain_gzip_members(spark):
    path = local(spark, "archive")
    warc.write_archive(frame(spark, [(1, "https://a.org/x", "<p>hello</p>" * 20), (2, "https://a.org/y", "<p>hello</p>" * 20)]), path)
    text = gzip.open(f"{path}/{sorted(files_of(path))[0]}").read().decode()
    assert text.count("WARC/1.1\r\n") == 3 and text.startswith("WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    assert "WARC-Target-URI: https://a.org/y\r\n" in text and "WARC-Type: revisit" in text and text.endswith("\r\n\r\n")


def test_empty_and_existing(spark):
    path = local(spark, "archive")
    warc.write_archive(frame(spark, []), path)
    assert warc.read_archive(spark, path).count() == 0
    with pytest.raises(ValueError):
        warc.write_archive(frame(spark, []), path)


def test_without_a_manifest_nothing_is_read(spark):
    path = local(spark, "archive")
    os.makedirs(f"{path}/_temporary/x")
    open(f"{path}/_temporary/x/shard-0000000-00000.warc.gz", "wb").write(b"half")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        warc.read_archive(spark, path)
    warc.write_archive(frame(spark, pages()[:50]), path)  # a dead writer's remains do no harm
    assert warc.read_archive(spark, path).count() == 50


def test_a_move_that_was_made_is_skipped(spark):
    path = local(spark, "archive")
    os.makedirs(f"{path}/_temporary/t")
    open(f"{path}/a.warc.gz", "wb").write(b"12345")
    open(f"{path}/_temporary/t/b.warc.gz", "wb").write(b"123")
    listed = spark.createDataFrame([("a.warc.gz", "_temporary/t/a.warc.gz", 5, 1, ""), ("b.warc.gz", "_temporary/t/b.warc.gz", 3, 1, "")],
                                   "name string, temporary string, bytes bigint, records bigint, sha256 string")
    warc.commit(listed, warc.uri_of(spark, path), path)
    assert sorted(files_of(path)) == ["a.warc.gz", "b.warc.gz"] and spark.read.parquet(f"{path}/manifest").count() == 2


def test_damage_is_noticed(spark):
    path = local(spark, "archive")
    warc.write_archive(frame(spark, [(1, "u", "some text that is long enough " * 9)]), path)
    name = f"{path}/{sorted(files_of(path))[0]}"
    raw = gzip.open(name).read().replace(b"long enough", b"long ENOUGH", 1)
    parts = raw.split(b"WARC/1.1\r\n")[1:]
    data = b"".join(gzip.compress(b"WARC/1.1\r\n" + p) for p in parts)
    open(name, "wb").write(data)
    with pytest.raises(Exception, match="another size"):
        warc.read_archive(spark, path).count()
    manifest = spark.read.parquet(f"{path}/manifest").withColumn("bytes", F.lit(len(data)).cast("bigint")).collect()
    spark.createDataFrame(manifest).write.mode("overwrite").parquet(f"{path}/manifest")
    with pytest.raises(Exception, match="wrong (block digest|payload)"):
        warc.read_archive(spark, path).count()


def test_bounds_find_the_last_start():
    rng = np.random.default_rng(1)
    keys = sorted({(int(p), int(b)) for p, b in rng.integers(0, 12, (60, 2))})
    starts = keys[::5]
    bounds = Bounds(*(np.array(x, np.int64) for x in zip(*starts)))
    page, bits = (np.array(x, np.int64) for x in zip(*keys))
    assert bounds.shard(page, bits).tolist() == [max(k for k, s in enumerate(starts) if s <= key) for key in keys]


def test_shards_have_about_their_size(spark):
    rng = random.Random(4)
    rows = [(rng.choice([5, 5, 5, rng.randrange(10 ** 12), -LARGEST]), rng.randrange(2 ** 32), rng.randint(1, 50)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "page bigint, bits bigint, weight bigint")
    bounds = warc.shard_bounds(df, 2000)
    shard = bounds.shard(*(np.array([r[k] for r in rows], np.int64) for k in (0, 1)))
    load = np.bincount(shard, [r[2] for r in rows])
    assert load.max() <= 2000 and len(load) < 1.5 * sum(r[2] for r in rows) / 2000 + 10
