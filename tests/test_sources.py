import datetime as dt
import tempfile

import pytest

from pyspark.sql import functions as F

from riskweave.functions.dates import parse_date, year_month
from riskweave.functions.nulls import na_token_to_null, to_double, to_long
from riskweave.schema import CONTRACT_COLUMNS, NA_TOKENS
from riskweave.sources.loans import loan_template, read_loans, tag_loans, unparsed_dates, validate_loans
from riskweave.sources.macro import build_country_mapping, build_macro_panel, country_lookup, strip_year_prefix
from riskweave.sources.sinks import export_csv, read_export
from riskweave.sources.versions import COMMITTED, drop_versions, read_table, replace_table, versions


def test_parse_date_day_first_lenient(spark):
    cases = {
        "01/02/2020": dt.date(2020, 2, 1),    # day first
        "01/13/2020": dt.date(2020, 1, 13),   # no 13th month -> month first
        "2020-13-01": dt.date(2020, 1, 13),   # ISO-like with day and month swapped
        "2020-01-02": dt.date(2020, 1, 2),    # ISO stays ISO
        "7 Mar 2021": dt.date(2021, 3, 7),
        "20200304": dt.date(2020, 3, 4),
        "31/02/2020": None,                   # no such day
        "junk": None,
        "  05-06-2019 ": dt.date(2019, 6, 5),
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r["s"]: r["d"] for r in df.select("s", parse_date("s").alias("d")).collect()}
    assert got == cases


def test_year_month_missing(spark):
    df = spark.createDataFrame([(dt.date(2020, 3, 4),), (None,)], "d date")
    assert sorted(r[0] for r in df.select(year_month("d", "NaT")).collect()) == ["2020-03", "NaT"]


def test_null_tokens_and_casts(spark):
    vals = list(NA_TOKENS) + ["12", " 3.0 ", "x", "NaN"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    out = df.select(na_token_to_null("v").alias("c")).select(
        "c", to_long("c").alias("l"), to_double("c").alias("d")).collect()
    assert all(r["c"] is None for r in out[:len(NA_TOKENS)])
    tail = out[len(NA_TOKENS):]
    assert [r["l"] for r in tail] == [12, 3, None, None]
    assert [r["d"] for r in tail] == [12.0, 3.0, None, None]


def test_read_loans_csv(spark):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/loans.csv"
    with open(path, "w") as f:
        f.write("borrower_id,borrower_type,loan_no,loan_date,due_date,payoff_date,tenure_days,amount,default_flag,"
                "extra,score,count,ok,ok_na\n")
        f.write("1,SME,10,05/01/2020,2020-02-05,,30,100.5,1,a,1.5,3,True,true\n")
        f.write("2,NA,11,n/a,2020-02-05,2020-01-20,30.0,,NA,b,NA,4,FALSE,\n")
        f.write("3,Retail,12,2020-01-07,,,#N/A,7,0,c,2,,false,False\n")
    df = read_loans(spark, path)
    assert validate_loans(df) == []
    rows = {r["loan_no"]: r for r in df.collect()}
    assert rows["10"]["loan_date"] == dt.date(2020, 1, 5) and rows["10"]["year"] == 2020
    assert rows["10"]["payoff_date"] is None and rows["10"]["default_flag"] == 1.0
    assert rows["11"]["borrower_type"] is None and rows["11"]["loan_date"] is None
    assert rows["11"]["tenure_days"] == 30 and rows["11"]["amount"] is None and rows["11"]["default_flag"] is None
    assert rows["12"]["tenure_days"] is None and rows["12"]["amount"] == 7.0
    types = dict(df.dtypes)
    assert (types["extra"], types["score"], types["count"], types["ok"], types["ok_na"]) == \
        ("string", "double", "bigint", "boolean", "string")
    assert [rows[k]["ok"] for k in ("10", "11", "12")] == [True, False, False]
    assert validate_loans(df.drop("amount")) == ["amount"]


def test_tags(spark):
    df = spark.createDataFrame([(1, "X")], "loan_no int, country_code string")
    r = tag_loans(df, "s1", "KEN").first()
    assert r["session_id"] == "s1" and r["country_code"] == "KEN"
    assert tag_loans(df, "s1").first()["country_code"] == "X"


def test_macro_builder(spark):
    wide = spark.createDataFrame(
        [("AAA", "Alpha", 1.0, None), ("BBB", "Beta", 2.0, 3.0), ("WLD", "World", 9.0, 9.0)],
        "economy string, Country string, YR2010 double, YR2011 double")
    eco = spark.createDataFrame([("AAA", "Alpha", False), ("BBB", "Beta", False), ("WLD", "World", True)],
                                "id string, name string, aggregate boolean")
    assert strip_year_prefix(wide).columns[2:] == ["2010", "2011"]
    panel = build_macro_panel(wide, eco)
    assert panel.columns == ["country_code", "country_name", "year", "gdp_usd", "frequency", "indicator_type"]
    got = sorted((r.country_code, r.year, r.gdp_usd) for r in panel.collect())
    assert got == [("AAA", "2010", 1.0), ("BBB", "2010", 2.0), ("BBB", "2011", 3.0)]
    assert {r.frequency for r in panel.collect()} == {"Annual"}
    mapping = build_country_mapping(eco)
    lk = country_lookup(spark, mapping).collect()
    assert [(r.country_name, r.country_code) for r in lk] == [("Alpha", "AAA"), ("Beta", "BBB")]
    fb = country_lookup(spark, None).collect()
    assert ("Kenya", "KEN") in [(r.country_name, r.country_code) for r in fb]


def test_export_roundtrip_keeps_spaces(spark):
    df = spark.createDataFrame([(1, " a ", 1.5, dt.date(2020, 1, 2)), (2, None, None, None)],
                               "k int, s string, v double, d date")
    path = export_csv(df, tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/out")
    back = read_export(spark, path, df.schema)
    assert sorted(back.collect()) == sorted(df.collect())


def test_write_table_replaces_what_it_reads(spark):
    import tempfile
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"
    replace_table(spark.range(5).withColumn("x", F.lit(0)), path)
    replace_table(read_table(spark, path).withColumn("x", F.lit(1)), path)
    assert [tuple(r) for r in read_table(spark, path).orderBy("id").collect()] == [(k, 1) for k in range(5)]


def test_a_writer_that_died_leaves_the_old_table(spark):
    import os
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_table(spark, path)
    replace_table(spark.range(3), path)
    # Dead before, during and after the write of its rows: no marker.
    os.makedirs(f"{path}/version-0000000001-aa")
    os.makedirs(f"{path}/version-0000000002-bb/_temporary/0")
    spark.range(9).write.parquet(f"{path}/version-0000000003-cc")
    assert read_table(spark, path).count() == 3 and len(versions(spark, path)) == 1
    held = read_table(spark, path)
    replace_table(spark.range(4), path)
    assert read_table(spark, path).count() == 4 and held.count() == 3  # readers of the old version go on
    assert drop_versions(spark, path) == [] and len(drop_versions(spark, path, 0.0)) == 4
    assert read_table(spark, path).count() == 4 and versions(spark, path, complete=False) == versions(spark, path)
    os.remove(f"{path}/{versions(spark, path)[0]}/{COMMITTED}")
    with pytest.raises(FileNotFoundError):
        read_table(spark, path)


def test_quoted_csv(spark, tmp_path):
    import csv
    rows = [("b1", 'SME "A", Ltd', "1", "2020-01-05 10:00", "", "", "30.5", "10.125", "0"), ("b2", "two\nlines", "2", "Jan 2020", "x", "", "31", "1e17", "1")]
    with open(tmp_path / "loans.csv", "w", newline="") as f:
        csv.writer(f).writerows([CONTRACT_COLUMNS, *rows])
    df = read_loans(spark, str(tmp_path / "loans.csv"))
    got = df.orderBy("loan_no").collect()
    assert [r["borrower_type"] for r in got] == ['SME "A", Ltd', "two\nlines"]
    assert [r["tenure_days"] for r in got] == [30.5, 31.0] and [r["amount"] for r in got] == [10.125, 1e17]
    assert [str(r["loan_date"]) for r in got] == ["2020-01-05", "2020-01-01"]
    back = read_export(spark, export_csv(df, str(tmp_path / "out")), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with open(next((tmp_path / "out").glob("part-*.csv")), newline="") as f:
        assert next(csv.DictReader(f))["borrower_type"] in ('SME "A", Ltd', "two\nlines")


def test_numbers_are_not_altered(spark):
    from riskweave.functions.nulls import to_double, to_long
    df = spark.createDataFrame([(x,) for x in ("30", "30.0", "30.5", "1D", "12F", " 7 ", "0x1", "1e3", "", None)], "x string")
    assert [r[0] for r in df.select(to_long("x")).collect()] == [30, 30, None, None, None, 7, None, 1000, None, None]
    assert [r[0] for r in df.select(to_double("x")).collect()] == [30.0, 30.0, 30.5, None, None, 7.0, None, 1000.0, None, None]


def test_more_date_layouts_and_their_count(spark):
    texts = ["2020-01-05 10:00", "2020-01-05T10:00", "2020-01-05T10:00:00Z", "2020-01-05 10:00:00.123", "5-1-2020 10:00", "5.1.20", "January 5 2020", "05 Jan 20",
             "2020-01-05T10:00:00+02:00"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    assert {str(r[0]) for r in df.select(parse_date("d")).collect()} == {"2020-01-05"}
    raw = spark.createDataFrame([(t, "n/a") for t in [*texts, "junk", "NA", "32/13/2020"]], "loan_date string, due_date string")
    assert {r["variable"]: r["unparsed"] for r in unparsed_dates(raw).collect()} == {"loan_date": 2, "due_date": 0}


def test_template(spark):
    assert loan_template(spark).columns == list(CONTRACT_COLUMNS)


def test_shape_guards_never_change_a_parse(spark):
    """The regex guards are a pure speed-up: same result as trying every layout."""
    import itertools
    from riskweave.schema import DATE_FORMATS
    days, months, years = ["1", "01", "9", "12", "13", "31", "32"], ["1", "02", "12", "13"], ["2020", "20", "19999"]
    texts = set()
    for d, m, y in itertools.product(days, months, years):
        for sep in "/-.":
            texts.update({f"{d}{sep}{m}{sep}{y}", f"{y}{sep}{m}{sep}{d}"})
        texts.update({f"{y}{m}{d}", f"{d}/{m}/{y} 10:05", f"{d}/{m}/{y} 9:05:07", f"{y}-{m}-{d} 10:05:07",
                      f"{y}-{m}-{d}T10:05:07", f"{y}-{m}-{d} 1:5:7"})
    for d, mon, y in itertools.product(["1", "07", "31"], ["Mar", "mar", "March", "Sept", "Sep", "Foo"], ["2021", "21"]):
        texts.update({f"{d} {mon} {y}", f"{d}-{mon}-{y}", f"{mon} {d}, {y}"})
    texts.update({"", " ", "junk", "2020-01-02 ", "+2020-01-02", "２０２０-01-02", "2020-01-02Z"})
    df = spark.createDataFrame([(t,) for t in sorted(texts)], "s string")
    c = F.trim(F.col("s"))
    plain = F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("date")
    diff = df.select("s", parse_date("s").alias("a"), plain.alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    assert diff.collect() == []
    assert df.select(parse_date("s").alias("a")).where("a IS NOT NULL").count() > 100


def test_read_loans_parquet_conforms_types(spark):
    import datetime as dt
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/loans_pq"
    df = spark.createDataFrame([(1, 2, "2020-03-04", 30, float("nan"), 1, 7)],
                               "borrower_id int, loan_no int, loan_date string, tenure_days int, "
                               "amount double, default_flag int, extra int")
    replace_table(df, path)
    got = read_loans(spark, path, fmt="parquet")
    types = dict(got.dtypes)
    assert (types["loan_no"], types["loan_date"], types["tenure_days"], types["default_flag"], types["extra"],
            types["year"]) == ("string", "date", "bigint", "double", "int", "int")
    r = got.first()
    assert r.loan_date == dt.date(2020, 3, 4) and r.year == 2020 and r.amount is None


def test_single_file_export_and_partitioned_table(spark):
    import os
    d = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.range(50).select(F.col("id").alias("loan_no"), (F.col("id") % 3 + 2000).cast("int").alias("year"),
                                (F.col("id") * 1.5).alias("amount")).repartition(4)
    out = export_csv(df, f"{d}/one", single_file=True)
    assert len([f for f in os.listdir(out) if f.endswith(".csv")]) == 1
    assert read_export(spark, out, df.schema).count() == 50
    replace_table(df, f"{d}/t", partition_by=["year"])
    there = os.listdir(f"{d}/t/{versions(spark, f'{d}/t')[0]}")
    assert sorted(x for x in there if x.startswith("year=")) == ["year=2000", "year=2001", "year=2002"]
    back = read_table(spark, f"{d}/t")
    assert dict(back.dtypes)["year"] == "int" and back.where("year = 2001").count() == 17


def test_workspace_feature_table_keeps_column_order(spark):
    from riskweave.plans.workspace import workspace
    ws = workspace(spark, "/root/testdata/sf0.001")
    assert ws.layered().columns == ws.layered_plan().columns
    assert dict(ws.layered().dtypes)["year"] == "int"
