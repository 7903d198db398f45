"""Metamorphic checks on the derived fixture."""

from pyspark.sql import functions as F

from riskweave.operators import models, portfolio
from riskweave.operators.layering import layer_macro
from riskweave.plans.workspace import workspace


def test_layering_keeps_loan_count_with_unique_keys(spark, small_sf):
    ws = workspace(spark, small_sf)
    assert ws.layered().count() == ws.loans.count()
    assert layer_macro(ws.loans, ws.macro, assert_unique=True).count() == ws.loans.count()


def test_class_counts_add_up(spark, small_sf):
    lay = workspace(spark, small_sf).layered()
    dist = sum(r.value for r in portfolio.default_distribution(lay).collect())
    nulls = lay.where(F.col("default_flag").isNull()).count()
    assert dist + nulls == portfolio.portfolio_kpis(lay).first().total_loans


def test_filters_partition_the_portfolio(spark, small_sf):
    lay = workspace(spark, small_sf).layered()
    types = [r[0] for r in portfolio.distinct_values(lay, "borrower_type").collect()]
    parts = sum(portfolio.filter_portfolio(lay, borrower_type=t).count() for t in types)
    assert parts + lay.where(F.col("borrower_type").isNull()).count() == lay.count()


def test_training_is_deterministic(spark, small_sf):
    ws = workspace(spark, small_sf)
    runs = [models.train_and_evaluate(ws.layered(), "XGBoost", prepared=ws.prepared, max_iter=5) for _ in range(2)]
    a, b = (sorted((r.loan_no, r.pd) for r in m.score().collect()) for m in runs)
    assert a == b
    for m in runs:
        m.release()
