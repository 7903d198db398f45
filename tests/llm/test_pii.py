import random
import re

import numpy as np
import pytest

from riskweave.llm import pii

# The base patterns as stated, run plainly.
PLAIN = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
         "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def digits(s):
    return [int(c) for c in s if c.isdigit()]


def plain_luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d))) % 10 == 0


VALID = {"email": lambda s: True, "ip": lambda s: all(float(p) <= 255 for p in s.split(".")),
         "card": lambda s: 16 <= len(digits(s)) <= 19 and plain_luhn(digits(s)), "phone": lambda s: 8 <= len(digits(s)) <= 15}


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if VALID[k](m.group())]


@pytest.fixture(scope="module")
def model():
    return pii.train(["the words of some text that goes on and on without any number in it at all "] * 3, steps=120)


def test_base_equals_plain_patterns(sample):
    rng = random.Random(1)
    texts = [r["text"] for r in sample.collect()]
    texts += ["".join(rng.choices("01259 .-+()@ab%_é", k=50)) for _ in range(5000)]
    texts += ["1.2.3.4.5", "300.1.1.1.1", "a@b@c.de", "4539578763621486 4539578763621486", "+1 (2) 3.4-567.89", "0001.2.3.4"]
    for t in texts:
        assert pii.base_spans(t) == plain(t)


def test_base_is_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "@" * 200_000):
        pii.base_spans(text)


def test_gradient():
    rng = np.random.default_rng(0)
    x, y = pii.tagged([pii.labelled_window(rng, ["some text here " * 20]) for _ in range(3)])
    p = pii.initial(rng)
    _, g = pii.loss_and_gradient(p, x, y)
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        moved = []
        for step in (1e-4, -1e-4):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            moved.append(pii.loss_and_gradient(q, x, y)[0])
        assert abs((moved[0] - moved[1]) / 2e-4 - g[name][at]) < 1e-3 * max(1, abs(g[name][at]))


def test_viterbi_is_the_best_path():
    p = pii.initial(np.random.default_rng(2))
    x = np.random.default_rng(3).integers(0, pii.N_CLASSES, (4, 5))
    tags, e = pii.viterbi(p, x)
    import itertools
    for n in range(5):
        def total(path):
            return p["s"][path[0]] + sum(e[t, n, a] for t, a in enumerate(path)) + sum(p["t"][a, b] for a, b in zip(path, path[1:]))
        best = max(itertools.product(range(len(pii.TAGS)), repeat=4), key=total)
        assert abs(total(best) - total(tags[:, n])) < 1e-9


def test_reconcile_takes_the_best_disjoint_set():
    found = [(0, 10, "card", 5.0), (8, 20, "card", 6.0), (10, 12, "ip", 2.0), (25, 30, "ip", -1.0)]
    assert pii.reconcile(found) == [("card", 0, 10), ("ip", 10, 12)]


def test_trained_model_adds_numbers_that_run_together(model):
    rng = np.random.default_rng(9)
    text = " ".join(f"the words {pii.luhn_number(rng, 16)} {pii.luhn_number(rng, 16)} and on it goes for some more text here," for _ in range(30))
    assert not [s for s in pii.base_spans(text) if s[0] == "card"]
    found = [text[s:e] for k, s, e in pii.model_spans(model, [text])[0] if k == "card"]
    assert len(found) >= 30 and all(pii.luhn(f) for f in found)


def test_hard_rows(hard, nothing, model):
    rows = pii.find(hard, model).collect()
    assert len(rows) == hard.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[12]["n_email"] == 1 and by[12]["n_ip"] == 1 and by[3]["spans"] == "" and by[4]["n_card"] == 0
    for r, t in zip(rows, [r["text"] for r in hard.collect()]):
        assert set(pii.joined(plain(t or "")).split(",")) <= set(r["spans"].split(","))
    assert pii.find(nothing, model).count() == 0
    safe = pii.mask(hard, model)
    assert safe.columns == hard.columns and safe.schema == hard.schema
    masked = {r["doc_id"]: r for r in safe.collect()}
    assert masked[12]["text"] == "mail <EMAIL> or <IP>" and masked[12]["n_chars"] == 20 and masked[3]["text"] is None


@pytest.mark.parametrize("kind, item, rest", [
    ("phone", "+33 6 12 34 56 78", " 0612345678"),
    ("phone", "+1 2 3 4 5 6 7 8 9 0", " 0612345678"),
    ("card", "41 11 11 11 11 11 11 11", " 0000"),
    ("card", "4111 1111 1111 1111", " 9999"),
    ("email", "a12345678901234567890123@some.org", " b")])
def test_items_of_any_groups_are_found_in_a_span_that_runs_on(kind, item, rest):
    text = "at " + item + rest
    found = pii.parts(text, 3, len(text), kind, 1.0)
    assert (3, 3 + len(item)) in [(s, e) for s, e, _, _ in found]
    if kind == "phone":
        assert max(found, key=lambda x: x[3])[:2] == (3, 3 + len(item))


def test_parts_stay_linear():
    text = "1 - " * 2000 + "- " * 20000 + "+ ( " * 2000
    assert len(pii.parts(text, 0, len(text), "phone", 1.0)) == 0
