"""URL filter: host and path rules, then a weighted vocabulary.

The vocabulary's terms are counted in the whole lower-cased URL by an
Aho-Corasick automaton; a hit counts if no letter or digit stands before or
after it. A strict term weighs as much as the limit, a soft term a part of
it, and distinct terms add up: one strict or several distinct soft terms
block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from riskweave.llm.frames import batch, with_fallback

# The terms.
STRICT_TERMS = ("adult", "casino", "escort", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
SOFT_TERMS = ("ads", "bets", "bonus", "cheap", "dating", "deals", "farm", "free", "loans", "pills", "poker", "promo", "sex", "track", "win")
SOFT_WEIGHT, LIMIT = 0.5, 1.0

ALLOW, BLOCK = "allow", "block"
RESULT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()),
                    ("strict_hits", pa.int32()), ("soft_hits", pa.int32())])

_A_TO_Z = {c: c + 32 for c in range(65, 91)}


@dataclass
class Filter:
    """``rules``: (verdict, host, path); ``weights``: term -> weight."""
    rules: list[tuple[str, str, str]]
    weights: dict[str, float] = field(default_factory=lambda: dict.fromkeys(STRICT_TERMS, LIMIT) | dict.fromkeys(SOFT_TERMS, SOFT_WEIGHT))
    limit: float = LIMIT


def parts(url: str | None) -> tuple[str, str]:
    """(host, path); both empty without a `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    tail = rest[end:]
    cut = min((k for k in map(tail.find, "?#") if k >= 0), default=len(tail))
    return rest[:end].translate(_A_TO_Z), tail[:cut]


class Judge:
    """A filter prepared for one Python process."""

    def __init__(self, config: Filter):
        import ahocorasick
        self.weights, self.limit = config.weights, config.limit
        self.automaton = ahocorasick.Automaton()
        for term in config.weights:
            self.automaton.add_word(term, term)
        if config.weights:
            self.automaton.make_automaton()
        self.rules: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in config.rules:
            self.rules.setdefault(host, []).append((path, verdict))

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, at = None, 0
        while at >= 0 and host:  # the host and every parent domain
            suffix = host[at:]
            for start, verdict in self.rules.get(suffix, ()):
                if path.startswith(start) and (best is None or len(suffix + start) > len(best[0])):
                    best = (suffix + start, verdict)
            at = host.find(".", at) + 1 or -1
        return best

    def hits(self, url: str) -> set[str]:
        """Distinct terms that occur in the URL between boundaries."""
        low, out = url.lower(), set()
        if self.weights:
            for last, term in self.automaton.iter(low):
                first = last + 1 - len(term)
                if not (first and low[first - 1].isalnum()) and not low[last + 1:last + 2].isalnum():
                    out.add(term)
        return out

    def judge(self, url: str | None) -> tuple:
        host, path = parts(url)
        found, rule = self.hits(url or ""), self.rule(host, path)
        strict = sum(self.weights[t] >= self.limit for t in found)
        method = BLOCK if sum(self.weights[t] for t in found) >= self.limit else ALLOW
        return host, path, rule and rule[0], rule[1] if rule else method, strict, len(found) - strict


def judge(pages: DataFrame, config: Filter) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits per row.

    A null url, or one without `://`, has empty host and path, so that no
    rule fits; the vocabulary still judges its text (null: allow). Repeated
    rows give repeated results; an empty table gives none; other columns
    are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Judge(config)
        for b in batches:
            rows = [one.judge(u) for u in b.column("url").to_pylist()]
            yield batch(RESULT, page_id=b.column("page_id"), **{f.name: [r[k] for r in rows] for k, f in enumerate(list(RESULT)[1:])})

    return with_fallback(pages, page_id="bigint", url="string").mapInArrow(
        run, "page_id bigint, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")
