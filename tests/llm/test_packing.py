import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskweave.llm import packing as P
from riskweave.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def fill(counts, capacity=1024):
    """Sequences of a plan, after checking that it places all, gapless."""
    bins, rank = defaultdict(list), Counter()
    for r in P.plan(counts, capacity):
        assert r.rank == rank[r.length]
        rank[r.length] += r.count
        for j in range(r.count):
            bins[r.sequence + j // r.each].append((r.offset + j % r.each * r.length, r.length))
    assert +rank == Counter({n: c for n, c in counts.items() if c})
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def best_fit_decreasing(counts, capacity=1024):
    rooms, bins = Counter(), 0
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            room = min((r for r, c in rooms.items() if c and r >= n), default=None)
            if room is None:
                bins, room = bins + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - n] += 1
    return bins


@pytest.mark.parametrize("counts", [{}, {1: 1}, {1024: 3}, {1: 5000}, {600: 4, 500: 3}, {341: 9}, {1000: 5, 24: 5, 23: 2}])
def test_small_plans_are_optimal(counts):
    assert fill(counts) == best_fit_decreasing(counts)


def test_random_plans_are_close_to_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(3):
        counts = dict(zip(range(1, 1025), rng.poisson(rng.choice([0.3, 3]), 1024).tolist()))
        assert fill(counts) <= 1.02 * best_fit_decreasing(counts) + 3


def test_configurations_reach_the_linear_optimum():
    base, x = P.configurations(np.array([300, 400, 700]), np.array([30.0, 30, 30]), 1000)
    assert np.allclose(base @ x, 30) and abs(x.sum() - (30 + 30 * 0.4 - 0)) <= 15


def test_coder_gives_the_tokenizers_ids(sample):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(PATH)
    texts = [r["text"] or "" for r in sample.collect()]
    texts += ["", " ", "  a", "a  b ", "a \nb", "it's we'll DON'T", "x <|endoftext|> y", "日本 “q” ² ½", "a\x1cb\x85c", "_a__1 2.3\r\n\t"]
    assert [P.coder(PATH).ids(t) for t in texts] == [np.array(reference.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def check(df, docs):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(PATH)
    rows, places, texts = df.collect(), defaultdict(list), defaultdict(Counter)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        texts[r["doc_id"]][(r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
    for x in places.values():
        x.sort()
        assert [o for o, _ in x] == np.cumsum([0, *[n for _, n in x]])[:-1].tolist() and sum(n for _, n in x) <= 1024
    want = defaultdict(Counter)
    for r in docs.collect():
        ids = reference.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        for k, (s, e) in enumerate([(0, first)] + [(s, s + 1024) for s in range(first, len(ids), 1024)]):
            want[r["doc_id"]][(k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert texts == want


def test_pack(hard, sample, nothing):
    check(P.pack(hard, PATH), hard)
    check(P.pack(sample, PATH), sample)
    assert P.pack(nothing, PATH).count() == 0
