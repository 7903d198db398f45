"""Lenient, day-first date parsing as a single JVM-side expression."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.schema import DATE_FORMATS

# Pattern letters -> the text they can match (a superset of what the parser accepts).
_TOKENS = (
    ("yyyy", r"\d{4,}"), ("yy", r"\d{2}"), ("MMMM", r"[A-Za-z]+"), ("MMM", r"[A-Za-z.]+"),
    ("MM", r"\d{2}"), ("M", r"\d{1,2}"), ("dd", r"\d{2}"), ("d", r"\d{1,2}"),
    ("HH", r"\d{2}"), ("H", r"\d{1,2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}"),
)


@lru_cache(maxsize=None)
def shape_regex(fmt: str) -> str:
    """Anchored regex of the text shape a datetime pattern can parse.

    Used only as a cheap guard: a failed parse costs an exception inside
    the JVM, a failed regex does not.
    """
    out, i = [], 0
    while i < len(fmt):
        if fmt[i] == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        for tok, rx in _TOKENS:
            if fmt.startswith(tok, i):
                out.append(rx)
                i += len(tok)
                break
        else:
            out.append(re.escape(fmt[i]))
            i += 1
    return "^" + "".join(out) + "$"


def parse_date(col: str | Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """First layout in ``formats`` that parses wins; nothing parses -> NULL.

    Day-first layouts come before month-first ones, so '01/02/2020' is
    1 February while '01/13/2020' (no 13th month) falls through to 13
    January. ISO text stays ISO. ``try_to_timestamp`` never raises under
    ANSI mode, so bad text becomes NULL instead of failing the job; each
    attempt is guarded by the layout's text shape, so rows only pay for
    the layouts that can fit them.
    """
    c = F.trim(F.col(col) if isinstance(col, str) else col)
    # Fractions of a second and a zone behind a time do not change the date.
    c = F.regexp_replace(c, r"(:[0-9]{2})([.,][0-9]+)?\s*(Z|[+-][0-9]{2}:?[0-9]{2})?$", "$1")
    return F.coalesce(*[F.when(c.rlike(shape_regex(f)), F.try_to_timestamp(c, F.lit(f)))
                        for f in formats]).cast("date")


def year_month(col: str | Column, missing: str | None = None) -> Column:
    """'yyyy-MM' text of a date; a missing date gives ``missing``."""
    c = F.col(col) if isinstance(col, str) else col
    ym = F.date_format(c, "yyyy-MM")
    return ym if missing is None else F.coalesce(ym, F.lit(missing))
