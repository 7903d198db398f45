"""Null handling of raw text and floating point columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.schema import NA_TOKENS


def na_token_to_null(col: str | Column, tokens: tuple[str, ...] = NA_TOKENS) -> Column:
    """Text cell -> NULL when it is one of the missing-value tokens, as it stands."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(*tokens), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(col: str | Column) -> Column:
    """NaN -> NULL, so no aggregate ever sees a NaN."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


# What counts as a number in text; a cast alone would also take '1D' and '2F'.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def number(col: str | Column) -> Column:
    """Value -> double; text that is no number gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    text = c.cast("string")
    return F.when(text.rlike(NUMBER) | text.rlike(INFINITY), F.trim(text).try_cast("double"))


def to_long(col: str | Column) -> Column:
    """Whole number -> bigint ('30.0' is one); a fraction or other text gives NULL."""
    c = F.col(col) if isinstance(col, str) else col
    d = number(c)
    return F.when(d.isNotNull(), F.coalesce(c.try_cast("bigint"), F.when(d == F.floor(d), d.try_cast("bigint"))))


def to_double(col: str | Column) -> Column:
    """Number -> double, NaN and other text give NULL."""
    return nan_to_null(number(col))
