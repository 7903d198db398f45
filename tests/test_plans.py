"""Physical-plan properties of registered queries: pushdown, pruning, joins."""

import __spark_entry__ as E


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_year_filter_prunes_feature_table_partitions(spark, small_sf):
    p = plan(E.queries()["year_rate_by_type"](spark, small_sf))
    part = p.split("PartitionFilters: ")[1].split("]")[0]
    assert "(year" in part and "= 1997)" in part


def test_type_filter_pushed_to_feature_table_scan(spark, small_sf):
    p = plan(E.queries()["sme_monthly_series"](spark, small_sf))
    assert "EqualTo(borrower_type,SME)" in p.split("PushedFilters: ")[1].split("\n")[0]


def test_monthly_series_reads_three_columns(spark, small_sf):
    p = plan(E.queries()["monthly_series"](spark, small_sf))
    schema = p.split("ReadSchema: ")[1].split("\n")[0]
    assert schema.startswith("struct<loan_date:date,amount:double,default_flag:double>")


def test_layering_is_broadcast_hash_join(spark, small_sf):
    from riskweave.plans.workspace import workspace
    p = plan(workspace(spark, small_sf).layered_plan())
    assert "BroadcastHashJoin" in p and "NestedLoop" not in p and "CartesianProduct" not in p


def test_macro_wide_scans_lineitem_once(spark, small_sf):
    p = plan(E.queries()["macro_wide"](spark, small_sf)).split("== Initial Plan ==")[0]
    assert p.count("FileScan parquet [l_suppkey") - p.count("ReusedExchange") <= 1


def test_shap_spreads_over_partitions(spark, small_sf):
    p = plan(E.queries()["shap_top10"](spark, small_sf))
    # Blocks of distinct cells and shares of trees meet by number; rows are not explained one by one.
    assert "REPARTITION_BY_NUM" in p and "MapInPandas" not in p and "hashpartitioning(loan_no" not in p


def test_quantiles_and_density_have_no_window(spark, small_sf):
    for name in ("describe_long", "amount_box", "impute_stats", "tenure_kde", "amount_kde"):
        p = plan(E.queries()[name](spark, small_sf))
        assert "Window" not in p and "NestedLoop" not in p and "CartesianProduct" not in p


def test_density_has_no_row_per_grid_point(spark, small_sf):
    p = plan(E.queries()["amount_kde"](spark, small_sf)).split("== Initial Plan ==")[0]
    # The grid is made after the sums are merged.
    assert p.count("Generate posexplode") == 1 and "Generate explode" not in p
