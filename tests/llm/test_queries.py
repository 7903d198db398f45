"""The registered queries: SQL where there is some, the contract's columns."""

import duckdb
import pytest

from riskweave.llm import ngram_join as N
from riskweave.llm.queries import ORACLE, QUERIES


def canon(columns, records):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(r[k] for k in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, small_sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_sf}/{t}.parquet')")
    df, res = QUERIES[name](spark, small_sf), con.execute(ORACLE[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([c[0] for c in res.description], res.fetchall())


@pytest.mark.parametrize("name, columns", [
    ("op1_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
    ("op9_nearest", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}),
    ("op10_quality", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
])
def test_columns(spark, small_sf, name, columns):
    df = QUERIES[name](spark, small_sf)
    assert {c: t for c, t in df.dtypes if c in columns} == columns and df.count() > 0


def test_limits_set_by_the_user_stay(spark, nothing):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.getAll.get(key)
    try:
        spark.conf.set(key, "64m")
        assert N.similar_classes(nothing).count() == 0
        assert spark.conf.get(key) in ("64m", "67108864b")
    finally:
        spark.conf.unset(key) if held is None else spark.conf.set(key, held)
