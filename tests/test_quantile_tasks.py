"""Exact quantiles deal no group to one task."""

from pyspark.sql import functions as F

from riskweave.functions.quantiles import exact_quantiles


def test_rows_of_a_group_do_not_meet_in_one_task(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the optimizer found the brackets large
    try:
        q = exact_quantiles(df, "v", [0.5], ["g"])
        plan = q._jdf.queryExecution().executedPlan().toString()
        assert {r.g: r.q0 for r in q.collect()} == {0: 9999.0, 1: 10000.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    sides = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert sides, plan
