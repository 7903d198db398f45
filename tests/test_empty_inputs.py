"""Every dashboard and statistics operator accepts an empty portfolio."""

import pytest

from riskweave.operators import density, portfolio, statistics

DDL = ("loan_no bigint, borrower_type string, loan_date date, tenure_days bigint, amount double, "
       "default_flag double, year int, gdp_usd double, x1 double, x2 double")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DDL)


def test_empty_dashboard(empty):
    assert portfolio.monthly_series(empty).count() == 0
    assert portfolio.default_rate_by(empty).count() == 0
    assert portfolio.distinct_values(empty, "year").count() == 0
    assert [r.value for r in portfolio.default_distribution(empty).collect()] == [0, 0]


def test_empty_statistics(empty):
    d = statistics.describe_long(empty).collect()
    assert [r["count"] for r in d] == [0] * len(d) and all(r.p50 is None for r in d)
    c = statistics.corr_long(empty, ["amount", "gdp_usd", "x1", "x2"]).collect()
    assert len(c) == 16 and all(r.corr is None for r in c)
    assert statistics.box_stats(empty, "amount").count() == 0
    assert density.kde(empty).count() == 0


def test_missing_columns_give_empty_tables(spark):
    bare = spark.range(3)
    for out in (portfolio.default_distribution(bare), portfolio.monthly_series(bare), portfolio.default_rate_by(bare),
                statistics.box_stats(bare, "amount"), density.kde(bare)):
        assert out.count() == 0
