"""Hard negatives and vector codes against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from riskweave.llm import hard_negatives as H
from riskweave.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<double>, label int, number string, v string, place string, codes string, entry string"
EXTRA = ("n", "v", "p", "c", "e")


def rows_of(seed=1, n=260, dim=24):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[i % 6]
        rows.append((i, [x + rng.gauss(0, 0.4) for x in c], rng.randrange(3)))
    rows[7] = (7, None, 1)
    rows[8] = (8, [float("nan")] + rows[9][1][1:], 1)
    rows[10] = (10, [None] + rows[9][1][1:], 1)
    rows[11] = (11, [float("-inf")] + rows[9][1][1:], 1)
    rows[20] = (20, rows[20][1], None)
    rows[30] = (30, [0.0] * dim, 2)
    rows[100] = (100, rows[40][1], 0)
    rows += [(300 + k, rows[40][1], 0) for k in range(12)]  # ties
    rows += [(400 + k, rows[40][1], 1) for k in range(12)]
    rows += [rows[50], rows[50]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_negatives(rows, anchor, k=5):
    held = {(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in rows if i is not None and label is not None and sound(v)}
    out = []
    for i, v, label in held:
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in held if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:k]:
            inside = sorted(s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p)[:k]
            out += [(i, pid, rank, nid, -p, -s) for rank, (s, nid, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 40, "block_anchors": 7}])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(H, "STEP", 16)
    rows = rows_of()
    got = H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0, **blocks)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_negatives_of_odd_tables(spark):
    rows = [(0, [], 1), (1, [], 1), (2, [], 2), (None, [1.0], 1), (10, [1.0, 2.0], 1), (11, [1.0, 2.5], 1), (12, [1.0, 2.25], 2),
            (20, [-5.0], 3), (21, [5.0], 3), (22, [-5.0], 4), (10, [1.0, 2.0, 3.0], 1), (10, [2.0, 2.0], 1)]
    got = H.mine(frame(spark, rows), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)
    assert H.mine(frame(spark, []), F.lit(True)).count() == 0


def test_scores_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for most, dim in ((1, 3), (90, 64), (2 ** 20, 2500), (2 ** 24, 64)):
        a, b = rng.integers(-most, most + 1, (5, dim)), rng.integers(-most, most + 1, (9, dim))
        a[0], b[0] = most, -most
        assert (H.scores(a, b, H.primes(dim * most * most)) == a @ b.T).all()


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError):
        H.mine(frame(spark, [(0, [1e9], 1), (1, [1.0], 1)]), F.lit(True))
    with pytest.raises(ValueError):
        H.mine(frame(spark, [(0, [1e300], 1)]), F.lit(True))


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, label, [math.floor(4096 * x) for x in v]) for i, v, label in rows if sound(v)]
    width = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    kept = [(i, label, v + [0] * (parts * width - len(v))) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))[:entries]
    books = [[v[p * width:(p + 1) * width] for _, _, v in first] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, _, v in kept:
            for p in range(parts):
                part = v[p * width:(p + 1) * width]
                members[p, nearest(p, part)[1]].append(part)
        for (p, k), some in members.items():
            books[p][k] = [sum(c) // len(some) for c in zip(*some)]
    out, total = [], defaultdict(int)
    for i, label, v in kept:
        found = [nearest(p, v[p * width:(p + 1) * width]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        total[label] += out[-1][2]
    return sorted([(i, code, error, total[label]) for i, code, error, label in out], key=str), books


@pytest.mark.parametrize("rows", [rows_of(), rows_of(2, n=300, dim=20), [], [(1, [], None)], [(1, [0.5, -3.0], 1), (None, [0.25], None), (2, None, 3), (3, [0.5, -3.0], 1)]])
def test_codes_equal_plain_lloyd(spark, rows):
    coded, books = V.compress(frame(spark, rows).repartition(3))
    got = V.report(coded, books)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want, plain = plain_codes(rows)
    found = got.collect()
    assert sorted([(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found], key=str) == want
    if rows and want:
        assert books.tolist() == plain and {r["codebooks_sha256"] for r in found} == {V.digest(np.array(plain))}


def test_entries_that_stay_are_not_compared_again():
    rng = np.random.default_rng(3)
    parts, books = rng.integers(-9, 10, (500, 4)), rng.integers(-9, 10, (16, 4))
    books[9] = books[2]  # ties
    codes, distances = V.assign(parts, books, np.ones(16, bool), None, None)
    for moving in ([], [5], [2, 9, 11], list(range(16))):
        after, moved = books.copy(), np.zeros(16, bool)
        after[moving] += rng.integers(-2, 3, (len(moving), 4))
        moved[moving] = True
        a, b = V.assign(parts, after, moved, codes, distances), V.full_scan(parts, after)
        assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_components_beyond_the_bound_raise(spark):
    with pytest.raises(ValueError):
        V.compress(frame(spark, [(0, [1e6] * 8, 1)]))
