import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweave.operators import features as fz

DDL = ("loan_no bigint, borrower_id bigint, borrower_type string, tenure_days bigint, amount double, "
       "default_flag double, year int, small int, flag boolean")


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL)


def test_training_rows_and_split_stable(spark):
    df = spark.range(2000).select(F.col("id").alias("loan_no"),
                                  F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 2).cast("double"))
                                  .alias("default_flag"))
    tr = fz.training_rows(df)
    assert tr.count() == 2000 - 286 and dict(tr.dtypes)["label"] == "int"
    a = {r.loan_no: r.is_test for r in fz.with_split(tr).collect()}
    b = {r.loan_no: r.is_test for r in fz.with_split(tr.repartition(7)).collect()}
    assert a == b
    share = sum(a.values()) / len(a)
    assert 0.17 < share < 0.23
    with pytest.raises(ValueError):
        fz.training_rows(df.drop("default_flag"))


def test_feature_spec_by_type(spark):
    rows = [(1, 1, "SME", 30, 1.0, 0.0, 2020, 1, True), (2, 2, None, 60, None, 1.0, None, 2, False)]
    df = frame(spark, rows)
    spec = fz.feature_spec(df)
    # ids and the target are dropped; int32 and boolean are not features; year kept (it has a null)
    assert spec.numeric == ("tenure_days", "amount", "year")
    assert spec.categorical == ("borrower_type",)
    no_null_year = frame(spark, [rows[0]])
    assert fz.feature_spec(no_null_year).numeric == ("tenure_days", "amount")
    assert fz.feature_spec(no_null_year, include_year=True).numeric == ("tenure_days", "amount", "year")


def test_fit_and_transform(spark):
    rows = [(i, i, t, d, a, 0.0, 2020, 0, True) for i, (t, d, a) in enumerate(
        [("SME", 10, 1.0), ("SME", 20, None), (None, 30, 3.0), ("Retail", 40, 4.0)])]
    df = frame(spark, rows)
    spec = fz.FeatureSpec(("tenure_days", "amount"), ("borrower_type",))
    prep = fz.fit_prep(df, spec)
    assert prep.medians == {"tenure_days": 25.0, "amount": 3.0}
    imputed = np.array([1.0, 3.0, 3.0, 4.0])
    assert prep.means["amount"] == pytest.approx(imputed.mean())
    assert prep.scales["amount"] == pytest.approx(imputed.std())       # population deviation
    assert [tuple(r) for r in prep.vocab.orderBy("variable", "idx").collect()] == [("borrower_type", v, i) for i, v in enumerate(["Retail", "SME", "missing"])]
    assert prep.feature_names == ["num__tenure_days", "num__amount", "cat__borrower_type_Retail",
                                  "cat__borrower_type_SME", "cat__borrower_type_missing"]
    unseen = frame(spark, [(9, 9, "Corporate", 25, None, 0.0, 2020, 0, True)])
    v = prep.transform(unseen, ["loan_no"]).select(vector_to_array("features").alias("x")).first().x
    assert v[0] == pytest.approx(0.0) and v[1] == pytest.approx((3.0 - imputed.mean()) / imputed.std())
    assert v[2:] == [0.0, 0.0, 0.0]                                     # unseen category: all zeros
    first = prep.transform(df, ["loan_no"]).orderBy("loan_no").select(vector_to_array("features").alias("x")).first().x
    assert first[2:] == [0.0, 1.0, 0.0]


def test_zero_variance_and_all_null(spark):
    rows = [(i, i, "A", 5, None, 0.0, 2020, 0, True) for i in range(4)]
    prep = fz.fit_prep(frame(spark, rows), fz.FeatureSpec(("tenure_days", "amount"), ()))
    assert prep.scales == {"tenure_days": 1.0} and prep.numeric == ["tenure_days"]


def test_many_categories(spark):
    rows = [(i, i, f"t{i:05d}", 5, 1.0, 0.0, 2020, 0, True) for i in range(5000)]
    df = frame(spark, rows)
    prep = fz.fit_prep(df.where("borrower_type <> 't00007'"), fz.FeatureSpec((), ("borrower_type",)))
    assert len(prep.feature_names) == 4999
    got = {r["loan_no"]: r["features"] for r in prep.transform(df, ["loan_no"]).collect()}
    assert got[0].size == 4999 and got[0].indices.tolist() == [0] and got[7].numNonzeros() == 0
    assert got[4999].indices.tolist() == [4998]
    idx = {r["loan_no"]: r["idx"] for r in fz.onehot_long(df, prep).collect()}
    assert idx[0] == 0 and idx[7] is None and idx[8] == 7


def test_no_row_is_lost_without_a_key(spark):
    df = spark.range(500).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("loan_no"), F.col("id").cast("double").alias("amount"),
                                 (F.col("id") % 2).cast("double").alias("default_flag"))
    for part in (df, df.drop("loan_no")):
        rows = fz.with_split(fz.training_rows(part))
        assert rows.where("is_test").count() + rows.where("not is_test").count() == 500
        assert rows.where("is_test is null").count() == 0 and 50 < rows.where("is_test").count() < 150


def test_small_scale_column_is_rescaled(spark):
    df = spark.range(10).select((F.col("id") * 1e-9).alias("a"), F.lit(3.5).alias("b"))
    prep = fz.fit_prep(df, fz.FeatureSpec(("a", "b"), ()))
    assert 2e-9 < prep.scales["a"] < 4e-9 and prep.scales["b"] == 1.0


def test_year_is_settled_on_all_rows(spark):
    from riskweave.operators.models import prepare
    df = spark.range(200).select(F.col("id").alias("loan_no"), (F.col("id") % 7).alias("tenure_days"), (F.col("id") % 2).cast("double").alias("default_flag"),
                                 F.when(F.col("id") > 0, F.lit(2000)).cast("int").alias("year"))
    assert "year" in prepare(df)[0].spec.numeric
    assert "year" in prepare(df.withColumn("default_flag", F.when(F.col("loan_no") > 0, F.col("default_flag"))))[0].spec.numeric


def test_large_vocabulary_is_numbered_in_order(spark):
    n = 200_000
    pairs = spark.range(n).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("variable"), F.md5(F.col("id").cast("string")).alias("category"))
    rows = fz.sorted_index(pairs.unionByName(spark.createDataFrame([("c", "é"), ("c", "Z"), ("c", "z"), ("c", "")], pairs.schema)))
    assert rows.count() == n + 4
    wrong = rows.withColumn("want", F.row_number().over(Window.partitionBy("variable").orderBy("category")) - 1).where("idx <> want")
    assert wrong.count() == 0
    assert [r["category"] for r in rows.where("variable = 'c'").orderBy("idx").collect()] == sorted(["é", "Z", "z", ""])
