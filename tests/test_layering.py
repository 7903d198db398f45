import pytest
from pyspark.sql import functions as F

from riskweave.operators.layering import LayerSpec, apply_layers, layer_macro

LOANS = [(1, "AAA", 2010), (2, "AAA ", 2011), (3, "BBB", 2010), (4, None, 2010), (5, "AAA", None), (6, "CCC", 2010)]
MACRO = [("AAA", "Alpha", "2010", 1.0, "Annual", "GDP"),
         ("AAA", "Alpha", "2011", 2.0, "Annual", "GDP"),
         ("AAA", "Alpha", "2011", 0.5, "Monthly", "GDP"),   # fan-out with the annual row
         ("BBB", "Beta", "2010", 3.0, None, "GDP"),         # NULL frequency never matches
         (" CCC", "Gamma", "2010", 4.0, "Annual", "GDP")]   # padded code matches after trim
MACRO_DDL = "country_code string, country_name string, year string, gdp_usd double, frequency string, indicator_type string"


@pytest.fixture
def frames(spark):
    loans = spark.createDataFrame(LOANS, "loan_no int, country_code string, year int")
    return loans, spark.createDataFrame(MACRO, MACRO_DDL)


def rows(df):
    return sorted((r.loan_no, r.gdp_usd, r.frequency) for r in df.collect())


EXPECTED = [(1, 1.0, "Annual"), (2, 0.5, "Monthly"), (2, 2.0, "Annual"), (3, None, None),
            (4, None, None), (5, None, None), (6, 4.0, "Annual")]


def test_layer_semantics(frames):
    loans, macro = frames
    out = layer_macro(loans, macro)
    assert out.columns == ["loan_no", "country_code", "year", "gdp_usd", "frequency"]
    assert rows(out) == EXPECTED


def test_shuffle_path_equals_broadcast_path(frames):
    loans, macro = frames
    assert rows(layer_macro(loans, macro)) == EXPECTED


def test_assert_unique(frames):
    loans, macro = frames
    with pytest.raises(ValueError):
        layer_macro(loans, macro, assert_unique=True)
    layer_macro(loans, macro.where(F.col("frequency") != "Monthly"), assert_unique=True)


def test_two_layers_suffix(frames, spark):
    loans, macro = frames
    annual = macro.where(F.col("frequency") == "Annual")
    out = apply_layers(loans, [annual, LayerSpec("gdp", lambda s: annual)], spark)
    assert out.columns[-4:] == ["gdp_usd", "frequency", "gdp_usd_1", "frequency_1"]
    assert out.count() == loans.count()
    assert apply_layers(loans, []) is loans


def test_plan_is_broadcast_hash_join(frames, spark, tmp_path):
    loans, macro = frames
    macro.write.parquet(str(tmp_path / "macro"))  # its size in bytes is known
    plan = layer_macro(loans, spark.read.parquet(str(tmp_path / "macro")))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_shuffle_path_with_hot_key_and_null_keys(spark):
    # one (country, year) holds a third of the loans, a tenth has no key at all
    n = 3000
    loans = spark.range(n).select(
        F.col("id").alias("loan_no"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).when(F.col("id") % 10 == 1, F.lit(None))
         .otherwise(F.concat(F.lit("C"), (F.col("id") % 50).cast("string"))).alias("country_code"),
        F.when(F.col("id") % 3 == 0, F.lit(2010)).otherwise((2000 + F.col("id") % 12).cast("int")).alias("year"))
    codes = ["HOT"] + [f"C{i}" for i in range(50)]
    macro = spark.createDataFrame([(c, f"name {c}", str(y), float(len(c) * y), "Annual", "GDP")
                                   for c in codes for y in range(2000, 2012)], MACRO_DDL)
    b = sorted(layer_macro(loans, macro).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = layer_macro(loans, macro)
        assert "SortMergeJoin" in shuffled._jdf.queryExecution().executedPlan().toString()
        a = spark.createDataFrame(shuffled.collect(), shuffled.schema)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert a.count() == n
    assert sorted(a.collect()) == b
    hot = a.where(F.col("country_code") == "HOT").select("gdp_usd").distinct().collect()
    assert [r.gdp_usd for r in hot] == [3.0 * 2010]
    assert a.where(F.col("country_code").isNull() & F.col("gdp_usd").isNotNull()).count() == 0


def test_named_layers(frames, spark):
    loans, macro = frames
    catalogue = {"gdp": LayerSpec("gdp", lambda s: macro)}
    assert rows(apply_layers(loans, ["gdp"], spark, catalogue)) == EXPECTED
    with pytest.raises(ValueError, match="unknown layers"):
        apply_layers(loans, ["gdp", "cpi"], spark, catalogue)


def test_folder_catalogue(spark, tmp_path):
    from riskweave.operators.layering import apply_layers, folder_catalogue
    from riskweave.sources.versions import replace_table
    macro = spark.createDataFrame([("KEN", "Kenya", "2010", 1.5, "Annual", "GDP")],
                                  "country_code string, country_name string, year string, gdp_usd double, frequency string, indicator_type string")
    replace_table(macro, str(tmp_path / "gdp"))
    macro.write.parquet(str(tmp_path / "debt"))
    (tmp_path / "rates.csv").write_text("country_code,country_name,year,gdp_usd,frequency,indicator_type\nKEN,Kenya,2010,9.5,Annual,RATE\n")
    (tmp_path / "_notes").mkdir()
    (tmp_path / "readme.txt").write_text("x")
    found = folder_catalogue(spark, str(tmp_path))
    assert list(found) == ["debt", "gdp", "rates"] and folder_catalogue(spark, str(tmp_path / "none")) == {}
    loans = spark.createDataFrame([(1, "KEN ", 2010)], "loan_no int, country_code string, year int")
    row = apply_layers(loans, ["gdp", "rates"], spark, found).first()
    assert (row["gdp_usd"], row["gdp_usd_1"]) == (1.5, 9.5)
