import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskweave.llm import ngram_join as N
from riskweave.llm.components import components
from riskweave.llm.words import shingle_hashes, word_hashes

FOLD = {c: c + 32 for c in [*range(65, 91), *(k for k in range(0xC0, 0xDF) if k != 0xD7)]}


def words(text):
    return re.findall("[0-9a-z\u0080-\U0010ffff]+", text.translate(FOLD))


def shingles(text):
    w = words(text or "")
    return frozenset([tuple(w[k:k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def brute(rows):
    """(doc_id, class_id, n_links, n_copies) by comparing all sets that share a shingle."""
    sets, post = defaultdict(list), defaultdict(set)
    for doc_id, text in rows:
        sets[shingles(text)].append(doc_id)
    alone = [(i, i, 0, 1) for i in sets.pop(frozenset(), [])]
    keys = list(sets)
    for n, key in enumerate(keys):
        for s in key:
            post[s].add(n)
    links, root = Counter(), list(range(len(keys)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, key in enumerate(keys):
        for m, both in Counter(m for s in key for m in post[s] if m < n).items():
            if 5 * both >= 4 * (len(key) + len(keys[m]) - both):
                links.update([n, m])
                root[find(n)] = find(m)
    least = defaultdict(list)
    for n, key in enumerate(keys):
        least[find(n)] += [i for i in sets[key] if i is not None]
    return sorted(alone + [(i, min(least[find(n)], default=None), links[n], len(sets[key]))
                           for n, key in enumerate(keys) for i in sets[key]], key=str)


def got(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"], r["n_copies"]) for r in df.collect()), key=str)


def near_copies(seed=1, origins=12, copies=9):
    """Families of texts with a few changed words each, some chained, and one
    line that all share."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, line = [], "all of these texts begin with the same line here "
    for _ in range(origins):
        text = rng.choices(vocabulary, k=rng.randint(20, 160))
        for _ in range(rng.randint(1, copies)):
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows), line + " ".join(text)))
    return rows


def test_equals_brute_force(spark, hard, sample):
    rows = near_copies()
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 15
    assert got(N.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == want
    assert got(N.similar_classes(hard)) == brute([(r["doc_id"], r["text"]) for r in hard.collect()])
    assert got(N.similar_classes(sample)) == brute([(r["doc_id"], r["text"]) for r in sample.collect()])


def test_small_leaves_and_blocks_change_nothing(spark, monkeypatch):
    rows = near_copies(seed=2, origins=5, copies=25)
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "BLOCK", 5)
    assert got(N.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute(rows)


def test_empty(nothing):
    assert N.similar_classes(nothing).count() == 0


def test_words_and_shingles_equal_plain_python():
    texts = ["", "a", "Ab cd, EF-gh ij kl", "ÉCOLE école  É", "one two three four", "x" * 5000, "1 2 3 4 5 6 1 2 3 4 5", "日本 語"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    h, doc, size = word_hashes(data, offsets)
    plain = [(n, w) for n, t in enumerate(texts) for w in words(t)]
    assert doc.tolist() == [n for n, _ in plain] and size.tolist() == [len(w.encode()) for _, w in plain]
    assert len({(x, w) for x, (_, w) in zip(h.tolist(), plain)}) == len({w for _, w in plain}) == len(set(h.tolist()))
    s, owner = shingle_hashes(h, doc, len(texts))
    for n, t in enumerate(texts):
        assert len(set(s[owner == n].tolist())) == len(shingles(t))


def test_tokens_estimate_similarity():
    rows = near_copies(seed=3)
    raw = [t.encode() for _, t in rows]
    _, _, tokens = N.sketches(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    t = [np.frombuffer(x, np.uint32) for x in tokens]
    for a, b in [(0, 1), (2, 3), (5, 9)]:
        x, y = shingles(rows[a][1]), shingles(rows[b][1])
        assert abs((t[a] == t[b]).mean() - len(x & y) / len(x | y)) < 0.2


def test_runs_reach_the_target():
    assert 1 - (1 - N.survival(N.MAX_DEPTH)) ** N.runs_for(0.99) >= 0.99


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5)], [(k, k + 1) for k in range(40)],
                                   [(0, k) for k in range(1, 50)] + [(60, 49), (70, 60), (70, 70)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = components(df).collect()
    assert len(rows) == len(root) and {r["node"]: r["root"] for r in rows} == {x: find(x) for x in list(root)}


def test_clusters_of_more_than_a_leaf_stay_whole(spark):
    rng = random.Random(5)
    rows = []
    for cluster in range(7):
        text = [f"c{cluster}x{rng.randrange(10 ** 6)}" for _ in range(3000)]
        for _ in range(N.LEAF + 12):
            copy = list(text)
            for _ in range(2):
                copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 9)}"
            rows.append((len(rows), " ".join(copy)))
    found = N.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)).collect()
    size = N.LEAF + 12
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in found} == {(i, i // size * size, size - 1) for i, _ in rows}


@pytest.mark.parametrize("changed", [8, 6, 4, 2])  # of 400 words: similarities from about 0.8 to 0.95
def test_recall_by_similarity_at_the_greatest_depth(spark, monkeypatch, changed):
    monkeypatch.setattr(N, "LEAF", 1)
    rng = random.Random(changed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(150):
        text = rng.choices(vocabulary, k=400)
        copy = list(text)
        for k in rng.sample(range(0, 400, 10), changed):
            copy[k] = rng.choice(vocabulary)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(copy))]
    want = sum(r[2] > 0 for r in brute(rows))
    have = sum(r[2] > 0 for r in got(N.similar_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))))
    assert want > 100 and have >= 0.97 * want
