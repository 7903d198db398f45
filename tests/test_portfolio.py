import datetime as dt

import pytest

from riskweave.operators import portfolio

DDL = "loan_no int, borrower_type string, loan_date date, amount double, default_flag double, year int"
DATA = [(1, "SME", dt.date(2020, 1, 5), 100.0, 1.0, 2020),
        (2, "SME", dt.date(2020, 1, 9), None, 0.0, 2020),
        (3, "Retail", dt.date(2020, 2, 1), 50.0, None, 2020),
        (4, None, None, 10.0, 1.0, None),
        (5, "Retail", dt.date(2021, 3, 1), None, 1.0, 2021)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(DATA, DDL)


def test_kpis(df, spark):
    r = portfolio.portfolio_kpis(df).first()
    assert (r.total_loans, r.total_defaults) == (5, 3) and r.default_rate == pytest.approx(60.0)
    e = portfolio.portfolio_kpis(spark.createDataFrame([], DDL)).first()
    assert (e.total_loans, e.total_defaults, e.default_rate) == (0, 0, 0.0)


def test_distribution(df, spark):
    got = [(r["class"], r.label, r.value) for r in portfolio.default_distribution(df).collect()]
    assert sorted(got) == [(0, "Performing", 1), (1, "Defaulted", 3)]
    only1 = spark.createDataFrame([(1, None, None, None, 1.0, None)], DDL)
    assert sorted(r.value for r in portfolio.default_distribution(only1).collect()) == [0, 1]


def test_monthly_series(df):
    got = {r.year_month: r for r in portfolio.monthly_series(df).collect()}
    assert list(got) == ["2020-01", "2020-02", "2021-03", "NaT"]
    jan = got["2020-01"]
    assert (jan.total_loans, jan.total_amount, jan.defaults) == (1, 100.0, 1.0)
    assert jan.default_rate == pytest.approx(100.0)
    mar = got["2021-03"]  # no amount at all: zero loans, rate undefined
    assert (mar.total_loans, mar.total_amount, mar.defaults, mar.default_rate) == (0, 0.0, 1.0, None)
    assert got["NaT"].total_loans == 1


def test_rate_by_type_and_filters(df):
    got = [(r.borrower_type, r.default_rate) for r in portfolio.default_rate_by(df).collect()]
    assert got == [("Retail", 100.0), ("SME", 50.0)]
    assert portfolio.filter_portfolio(df) is df
    assert portfolio.filter_portfolio(df, borrower_type="SME").count() == 2
    assert portfolio.filter_portfolio(df, year="2021").count() == 1
    assert [r[0] for r in portfolio.distinct_values(df, "borrower_type").collect()] == ["Retail", "SME"]
    assert [r.loan_no for r in portfolio.preview(df, 2).collect()] == [1, 2]
