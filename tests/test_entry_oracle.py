"""Driver contract: entry() runs, and every SQL-checked query equals its
DuckDB oracle on the smallest test data (the driver does the same at sf0.01)."""

import datetime as dt
import math
import os
import re

import pytest

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if hasattr(v, "item"):
        return norm(v.item())
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def canon(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(small_sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{small_sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["borrower_type", "default_rate"]
    assert df.count() == 3


def test_every_oracle_key_is_registered():
    assert set(E.oracle_sql()) <= set(E.queries())


def close(a, b):
    """Equal, or doubles apart by summation order only (one unit of the 6th
    decimal after rounding, or 1e-9 relative)."""
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= max(1.5e-6, 1e-9 * max(abs(a), abs(b)))
    return a == b


def elsewhere(name):
    """Queries with tests of their own beside the operators that they run."""
    return name == "pipeline" or re.match(r"op[0-9]+_", name)


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if not elsewhere(k)))
def test_query_matches_oracle(name, spark, small_sf, duck):
    df = E.queries()[name](spark, small_sf)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    want = canon(ocols, res.fetchall())
    if got != want:  # double aggregates depend on summation order in the last bits
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
        assert not bad, bad[:3]


@pytest.mark.parametrize("name", sorted(k for k in set(E.queries()) - set(E.oracle_sql()) if not elsewhere(k)))
def test_rows_only_queries_run(name, spark, small_sf):
    assert E.queries()[name](spark, small_sf).count() > 0
