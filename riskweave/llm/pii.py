"""Personal data: exact base rules plus a character BiLSTM-CRF.

The base rules find emails, IPv4 addresses, card numbers (Luhn) and
international phone numbers in linear time. A bidirectional LSTM over
character classes with CRF transitions (numpy; trained by back-propagation
on labelled spans) adds spans that the rules miss, such as numbers that run
into each other. Every text is covered by overlapping windows; each window
is decoded by Viterbi, and the spans of all windows of a text are reconciled
at once: the non-overlapping selection with the largest total score wins.

Every span holds a digit or an `@`, so that a window without one cannot give
a span; it need not be decoded.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.frames import batch, spans, utf8, with_fallback

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32
HIDDEN = 20
# Bound of the training sample: documents, and characters of each.
TRAIN_DOCS, TRAIN_CHARS = 300, 20_000
STEPS, BATCH = 420, 48

# What decoding takes off the score of "no span": spans are validated afterwards.
LEAN = 3.0

Span = tuple[str, int, int]

RESULT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

# --- base rules --------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_ip(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def is_card(s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_phone(s: str) -> bool:
    return 8 <= len(re.sub("[^0-9]", "", s)) <= 15


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, `@`, dotted domain, from each `@`."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[Span]:
    """All base spans, by kind as listed, then start; code points."""
    out = emails(text)
    for kind, pattern, valid in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(m.group())]
    return out


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(found, key=lambda x: (KINDS.index(x[0]), x[1])))


# --- model -------------------------------------------------------------------

TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
SYMBOLS = "@.-+() \n_%,:/"  # a class each; then digit, lower, upper, other letter, other, padding
N_CLASSES = len(SYMBOLS) + 6
PAD = N_CLASSES - 1


def _classes() -> np.ndarray:
    """Class of each code point up to 0x24F; further ones count as letters."""
    out = np.full(0x250, N_CLASSES - 2, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if ch in SYMBOLS:
            out[c] = SYMBOLS.index(ch)
        elif "0" <= ch <= "9":
            out[c] = len(SYMBOLS)
        elif "a" <= ch <= "z":
            out[c] = len(SYMBOLS) + 1
        elif "A" <= ch <= "Z":
            out[c] = len(SYMBOLS) + 2
        elif ch.isalpha():
            out[c] = len(SYMBOLS) + 3
    return out


CLASSES = _classes()


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < len(CLASSES), CLASSES[np.minimum(code, len(CLASSES) - 1)], len(SYMBOLS) + 3)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in ("f", "b"):
        p[f"x{d}"] = rng.normal(0, 0.3, (N_CLASSES, 4 * HIDDEN))
        p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
        p[f"c{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)  # gates in, forget, out, candidate
    return p | {"o": rng.normal(0, 0.2, (2 * HIDDEN, len(TAGS))), "ob": np.zeros(len(TAGS)),
                "t": rng.normal(0, 0.1, (len(TAGS), len(TAGS))), "s": np.zeros(len(TAGS))}


def lstm(p: dict, d: str, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Hidden states over time of classes ``x`` (time, batch)."""
    n = x.shape[1]
    h, c, out, memory = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), np.zeros((len(x), n, HIDDEN)), []
    for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
        z = p[f"x{d}"][x[t]] + h @ p[f"h{d}"] + p[f"c{d}"]
        gates, g = sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
        before, c = c, f * c + i * g
        tanh = np.tanh(c)
        if keep:
            memory.append((t, i, f, o, g, before, tanh, h))
        h = o * tanh
        out[t] = h
    return out, memory


def lstm_back(p: dict, d: str, x: np.ndarray, memory: list, dout: np.ndarray, grad: dict) -> None:
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t, i, f, o, g, before, tanh, h in reversed(memory):
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tanh ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g ** 2)], 1)
        grad[f"x{d}"] += np.eye(N_CLASSES)[x[t]].T @ dz
        grad[f"h{d}"] += h.T @ dz
        grad[f"c{d}"] += dz.sum(0)
        dh, dc = dz @ p[f"h{d}"].T, dc * f


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    both = np.concatenate([lstm(p, "f", x)[0], lstm(p, "b", x)[0]], 2)
    return both @ p["o"] + p["ob"]


def loss_and_gradient(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of tags ``y`` (time, batch) and its gradient."""
    steps, n = x.shape
    hf, mf = lstm(p, "f", x, keep=True)
    hb, mb = lstm(p, "b", x, keep=True)
    both = np.concatenate([hf, hb], 2)
    e = both @ p["o"] + p["ob"]
    alpha = np.zeros_like(e)
    alpha[0] = e[0] + p["s"]
    for t in range(1, steps):
        alpha[t] = e[t] + logsumexp(alpha[t - 1][:, :, None] + p["t"], 1)
    beta = np.zeros_like(e)
    for t in range(steps - 2, -1, -1):
        beta[t] = logsumexp(p["t"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
    z = logsumexp(alpha[-1], 1)
    rows = np.arange(n)
    gold = p["s"][y[0]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(p["t"][y[t - 1], y[t]] for t in range(1, steps))
    de = np.exp(alpha + beta - z[None, :, None])
    grad = {k: np.zeros_like(v) for k, v in p.items()}
    grad["s"] = de[0].sum(0) - np.bincount(y[0], minlength=len(TAGS))
    for t in range(1, steps):
        pair = alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t])[:, None, :] - z[:, None, None]
        grad["t"] += np.exp(pair).sum(0)
        np.subtract.at(grad["t"], (y[t - 1], y[t]), 1)
    de[np.arange(steps)[:, None], rows[None], y] -= 1
    grad["o"] = np.tensordot(both, de, ([0, 1], [0, 1]))
    grad["ob"] = de.sum((0, 1))
    dboth = de @ p["o"].T
    lstm_back(p, "f", x, mf, dboth[:, :, :HIDDEN], grad)
    lstm_back(p, "b", x, mb, dboth[:, :, HIDDEN:], grad)
    return float((z - gold).mean()), {k: v / n for k, v in grad.items()}


def viterbi(p: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best tags, emissions leaning to spans) of windows ``x`` (time, batch)."""
    e = emissions(p, x)
    e[:, :, 0] -= LEAN
    best, back = e[0] + p["s"], np.zeros((len(x), x.shape[1], len(TAGS)), np.int8)
    for t in range(1, len(x)):
        via = best[:, :, None] + p["t"]
        back[t] = via.argmax(1)
        best = via.max(1) + e[t]
    tags = np.zeros(x.shape, np.int64)
    tags[-1] = best.argmax(1)
    rows = np.arange(x.shape[1])
    for t in range(len(x) - 1, 0, -1):
        tags[t - 1] = back[t, rows, tags[t]]
    return tags, e


# --- training ----------------------------------------------------------------

def luhn_number(rng: np.random.Generator, n: int) -> str:
    head = "".join(map(str, rng.integers(0, 10, n - 1)))
    return next(head + str(k) for k in range(10) if luhn(head + str(k)))


def made(rng: np.random.Generator) -> tuple[str, str]:
    """(kind or "", string) of one made-up item; "" marks look-alikes."""
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(a, b)))
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    kind = rng.choice(["email", "ip", "card", "phone", ""], p=[0.2, 0.17, 0.25, 0.2, 0.18])
    if kind == "email":
        local = word(2, 9) + str(rng.choice(["", ".", "_", "-"])) + (word(2, 7) if rng.random() < 0.5 else number(2))
        return kind, f"{local}@{word(3, 8)}{number(1) if rng.random() < 0.5 else ''}.{word(3, 8)}.com" if rng.random() < 0.6 else f"{local}@{word(3, 9)}.org"
    if kind == "ip":
        return kind, ".".join(map(str, rng.integers(1, 256, 4)))
    if kind == "card":
        n = luhn_number(rng, int(rng.choice([16, 16, 16, 17, 18, 19])))
        if rng.random() < 0.25:
            sep = str(rng.choice([" ", "-"]))
            n = sep.join(n[k:k + 4] for k in range(0, len(n), 4))
        return kind, n
    if kind == "phone":
        form = rng.choice(["+{} ({}) {}-{}", "+{}-{}-{}-{}", "+{} {} {} {}", "+{}.{}.{}.{}"])
        return kind, str(form).format(rng.integers(1, 99), number(3), number(3), number(4))
    return "", str(rng.choice([f"{rng.integers(1, 20)}.{rng.integers(0, 10)}", number(int(rng.integers(1, 8))), f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}.",
                               f"{number(4)}-{number(2)}-{number(2)}", "".join(rng.choice(list("0123456789abcdef"), 24)), "AKIA" + word(4, 9).upper() + number(3)]))


def run_together(text: str) -> bool:
    """Long numbers that the base rules drop say nothing about what they hold."""
    return any(len(re.sub("[^0-9]", "", m.group())) > 15 and not valid(m.group())
               for pattern, valid in ((CARD, is_card), (PHONE, is_phone)) for m in pattern.finditer(text))


def labelled_window(rng: np.random.Generator, background: list[str]) -> tuple[str, list[Span]]:
    """A window of a training text with items put into it, and their spans."""
    src = background[rng.integers(len(background))] if background else ""
    if len(src) > WINDOW:
        k = int(rng.integers(0, len(src) - WINDOW))
        src = src[k:k + WINDOW]
    if rng.random() < 0.3 and not run_together(src[:WINDOW]):  # as it is, labelled by the base rules
        return src[:WINDOW], base_spans(src[:WINDOW])
    words, text, spans = re.split("([ \n])", src), "", []
    places = set(rng.integers(0, max(1, len(words)), rng.integers(1, 4)).tolist())
    for k, w in enumerate(words):
        if k in places:
            kind, item = made(rng)
            for _ in range(int(rng.choice([1, 1, 2, 3]))):  # run together: the same item again, or others
                if rng.random() < 0.7:
                    kind, item = made(rng)
                lead, tail = str(rng.choice(["", "", "", "(", '"'])), str(rng.choice(["", "", "", "", "", ".", ",", "!!", "###"]))
                text += lead
                if kind:
                    spans.append((kind, len(text), len(text) + len(item)))
                text += item + tail + " "
        text += w
    k = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
    cut = [(kind, max(0, s - k), min(WINDOW, e - k)) for kind, s, e in spans if s - k < WINDOW and e > k]
    return text[k:k + WINDOW], cut


def tagged(windows: list[tuple[str, list[Span]]]) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.full((WINDOW, len(windows)), PAD), np.zeros((WINDOW, len(windows)), np.int64)
    for n, (text, spans) in enumerate(windows):
        x[:len(text), n] = encode(text)
        for kind, s, e in spans:
            y[s:e, n] = 2 + 2 * KINDS.index(kind)
            y[s, n] -= 1
    return x, y


def train(background: list[str], steps: int = STEPS, seed: int = 7) -> dict[str, np.ndarray]:
    """Fit the BiLSTM-CRF on labelled windows (Adam)."""
    rng = np.random.default_rng(seed)
    p = initial(rng)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, y = tagged([labelled_window(rng, background) for _ in range(BATCH)])
        _, g = loss_and_gradient(p, x, y)
        norm = np.sqrt(sum(float((a ** 2).sum()) for a in g.values()))
        rate = 0.03 * min(1, 2.5 * (1 - step / (steps + 1)))
        for k in p:
            a = g[k] * min(1, 20 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a ** 2
            p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return p


def train_on(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS) -> dict[str, np.ndarray]:
    """Model whose windows come from at most ``max_docs`` documents, in the
    order of a hash of the text, of a longer one its first ``max_chars``
    characters (the bounds are on training only); half of them hold a digit
    or an `@`."""
    rows = with_fallback(docs, text="string").select(F.substring("text", 1, max_chars).alias("text")).where(F.length("text") > 0)
    order, half = F.xxhash64("text").alias("h"), max_docs // 2
    picked: set[str] = set()
    for part in (rows.where(F.col("text").rlike("[0-9@]")), rows):
        # The hashes first, so that the texts of the sample alone reach the driver.
        lowest = [r["h"] for r in part.select(order).distinct().orderBy("h").limit(half).collect()]
        if lowest:
            picked |= {r["text"] for r in part.where(order <= lowest[-1]).select("text").distinct().limit(half).collect()}
    return train(sorted(picked))


# --- decoding ----------------------------------------------------------------

def window_spans(tags: np.ndarray, e: np.ndarray, start: int) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of the spans of one window."""
    out, t, n = [], 0, len(tags)
    while t < n:
        if tags[t] == 0:
            t += 1
            continue
        kind, end = (tags[t] - 1) // 2, t + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        score = float((e[np.arange(t, end), tags[t:end]] - e[t:end, 0]).sum())
        out.append((start + t, start + end, KINDS[kind], score))
        t = end
    return out


def reconcile(found: list[tuple[int, int, str, float]]) -> list[Span]:
    """The non-overlapping spans with the largest total score."""
    found = sorted({f[:3]: f for f in sorted(found, key=lambda f: f[3])}.values(), key=lambda f: (f[1], f[0]))
    ends, best, take = [f[1] for f in found], [0.0], []
    for k, (s, _, _, score) in enumerate(found):
        j = bisect_right(ends, s, 0, k)
        take.append((score > 0 and best[j] + score > best[k], j))
        best.append(best[j] + score if take[-1][0] else best[k])
    out, k = [], len(found)
    while k:
        chosen, j = take[k - 1]
        if chosen:
            out.append((found[k - 1][2], found[k - 1][0], found[k - 1][1]))
            k = j
        else:
            k -= 1
    return out[::-1]


def trimmed(text: str, kind: str, s: int, e: int) -> tuple[int, int]:
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while e > s and not text[e - 1].isalnum():
        e -= 1
    return s, e


def plausible(kind: str, s: str) -> bool:
    """What a model span must still be to count."""
    if kind == "email":
        return emails(s) == [("email", 0, len(s))]
    if kind == "ip":
        return IP.fullmatch(s) is not None and is_ip(s)
    if kind == "card":
        return CARD.fullmatch(s) is not None and is_card(s)
    return re.fullmatch(r"[+(][0-9][\x20().0-9-]*[0-9]", s) is not None and is_phone(s)


# Digits of the longest item that may hold blanks (a card).
MOST_DIGITS = 19


def parts(text: str, start: int, end: int, kind: str, score: float) -> list[tuple[int, int, str, float]]:
    """A span as it is, if plausible; else its plausible words and runs of
    words (items that run together), with their share of the score. A run
    starts and ends with a word that has digits, and has up to MOST_DIGITS."""
    s, e = trimmed(text, kind, start, end)
    if plausible(kind, text[s:e]):
        return [(s, e, kind, score)]
    words = [(m.start() + start, m.end() + start) for m in re.finditer(r"\S+", text[start:end])]
    digits = [len(re.sub("[^0-9]", "", text[s:e])) for s, e in words]
    numbered = [k for k, n in enumerate(digits) if n]
    runs = [(k, k) for k in range(len(words))]
    for i, k in enumerate(numbered):
        total = digits[k]
        for last in numbered[i + 1:i + MOST_DIGITS]:
            total += digits[last]
            if total > MOST_DIGITS:
                break
            runs.append((k, last))
    out = []
    for k, last in runs:
        s, e = trimmed(text, kind, words[k][0], words[last][1])
        if plausible(kind, text[s:e]):
            out.append((s, e, kind, score * (e - s) / (end - start)))
    return out


def model_spans(p: dict, texts: list[str]) -> list[list[Span]]:
    """Reconciled model spans of every text."""
    where: list[tuple[int, int]] = []
    for n, text in enumerate(texts):
        at = np.flatnonzero(np.isin(encode(text), (len(SYMBOLS), SYMBOLS.index("@"))))
        last = at // STRIDE
        where += [(n, int(k)) for k in np.unique(np.concatenate([last, np.maximum(last - 1, 0)]))]
    found: list[list] = [[] for _ in texts]
    for lo in range(0, len(where), 2048):
        part = where[lo:lo + 2048]
        x = np.full((WINDOW, len(part)), PAD)
        for m, (n, k) in enumerate(part):
            code = encode(texts[n][k * STRIDE:k * STRIDE + WINDOW])
            x[:len(code), m] = code
        tags, e = viterbi(p, x)
        for m in np.flatnonzero((tags > 0).any(0)):
            n, k = part[m]
            found[n] += window_spans(tags[:, m], e[:, m], k * STRIDE)
    out = []
    for text, spans in zip(texts, found):
        kept = []
        for s, e, kind, score in spans:
            kept += parts(text, s, min(e, len(text)), kind, score)
        out.append(reconcile(kept))
    return out


def all_spans(base: list[Span], model: list[Span]) -> list[Span]:
    """The base spans and those of the model that overlap none of them."""
    held = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in held], []
    for _, e in held:
        reach.append(max(e, reach[-1] if reach else 0))
    extra = []
    for kind, s, e in model:
        k = bisect_right(starts, e - 1)
        if not k or reach[k - 1] <= s:
            extra.append((kind, s, e))
    return base + extra


def spans_of(p: dict, column: pa.Array) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of every text of an Arrow column."""
    data, offsets = utf8(column)
    out: list = [([], [])] * (len(offsets) - 1)
    for i, j in spans(offsets):
        part = data[offsets[i]:offsets[j]]
        at = np.flatnonzero((part == 64) | ((part >= 48) & (part <= 57))) + offsets[i]
        some = np.unique(np.searchsorted(offsets, at, "right") - 1)
        texts = column.take(pa.array(some)).to_pylist()
        for n, text, model in zip(some.tolist(), texts, model_spans(p, texts)):
            base = base_spans(text)
            out[n] = (base, all_spans(base, model))
    return out


def find(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base
    spans, and spans (base and model) of every row of ``docs``.

    A null or empty text has no spans (empty strings, digest of the empty
    string). Repeated rows give repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = spans_of(shared.value, b.column("text"))
            base = [joined(x) for x, _ in found]
            yield batch(RESULT, doc_id=b.column("doc_id"), base_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in base],
                        spans=[joined(x) for _, x in found],
                        **{f"n_{k}": [sum(kind == k for kind, _, _ in x) for x, _ in found] for k in KINDS})

    return with_fallback(docs, doc_id="bigint", text="string").mapInArrow(
        run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """``text`` with every span (merged where kinds overlap) replaced by a tag."""
    out, free = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= free:
            out += [text[free:s], f"<{kind.upper()}>"]
        free = max(free, e)
    return "".join(out) + text[free:]


def mask(docs: DataFrame, model: dict) -> DataFrame:
    """``docs``, all columns, with the spans replaced by tags of their kinds
    and n_chars (if there) set to the new length. Null texts stay null."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for n, (_, spans) in enumerate(spans_of(shared.value, b.column("text"))):
                if spans:
                    texts[n] = masked(texts[n], spans)
            at = {f.name: k for k, f in enumerate(b.schema)}
            columns = list(b.columns)
            columns[at["text"]] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in at:
                columns[at["n_chars"]] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.select(names).mapInArrow(run, schema)
