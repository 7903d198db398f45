"""The query registry: one callable ``(spark, sf_dir) -> DataFrame`` per
operator of the survey inventory. Inexact doubles (means, deviations,
correlations, densities, interpolated quantiles) are rounded to 6 places
so the comparison with the DuckDB oracle is independent of summation
order, money totals to cents; exact values (counts, minima) are not.
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.functions.dates import parse_date
from riskweave.operators import boosting, density, explain, features, models, portfolio, risk, statistics
from riskweave.operators.layering import LayerSpec, apply_layers, folder_catalogue, layer_macro
from riskweave.plans.workspace import workspace
from riskweave.session import scratch_path
from riskweave.sources import sinks, versions
from riskweave.sources.loans import read_loans, rejected_records, tag_loans, unparsed_dates
from riskweave.sources.macro import build_macro_panel, country_lookup, read_macro, resolve_country_code

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries (fixed so the oracle can mirror them).
FILTER_TYPE = "SME"
FILTER_YEAR = 1997
TAG_SESSION = "fixture-session"
TAG_COUNTRY = "Country 7"
FANOUT_YEAR, FANOUT_FREQUENCY, NULL_FREQ_YEAR = "1996", "Quarterly", "1997"


def round2(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Money totals to cents, independent of the order of summation."""
    return df.withColumns({c: F.round(F.col(c), 2) for c in cols})


def round6(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ---------------------------------------------------------------- sources

def q_loan_panel(spark, sf_dir):
    return workspace(spark, sf_dir).loans


def q_loan_csv_ingest(spark, sf_dir):
    return read_loans(spark, workspace(spark, sf_dir).loan_csv_path, fmt="csv")


def q_rejected_records(spark, sf_dir):
    """Without the places, which depend on how the upload was written."""
    return rejected_records(spark, workspace(spark, sf_dir).uneven_csv_path).select("cells", "error", "record")


def q_parse_dates(spark, sf_dir):
    raw = workspace(spark, sf_dir).loan_csv
    return raw.select(F.col("loan_no").cast("bigint").alias("loan_no"),
                      F.col("loan_date").alias("raw_date"),
                      parse_date("loan_date").alias("loan_date"))


def q_tagged_loans(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    row = resolve_country_code(country_lookup(spark, ws.country_mapping), TAG_COUNTRY).first()
    return tag_loans(ws.loans, TAG_SESSION, row["country_code"] if row else None)


def q_replaced_lookup(spark, sf_dir):
    """A stored lookup replaced by one that was read from it."""
    path = versions.replace_table(workspace(spark, sf_dir).country_mapping, scratch_path(spark, "lookup"))
    versions.replace_table(country_lookup(spark, versions.read_table(spark, path)), path)
    return versions.read_table(spark, path)


def q_country_lookup(spark, sf_dir):
    return country_lookup(spark, workspace(spark, sf_dir).country_mapping)


def q_macro_wide(spark, sf_dir):
    return workspace(spark, sf_dir).macro_wide


def q_macro_panel(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return build_macro_panel(ws.macro_wide, ws.economies)


# ---------------------------------------------------------------- layering

def q_macro_layer(spark, sf_dir):
    return workspace(spark, sf_dir).layered_plan()


def q_layer_by_name(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return apply_layers(ws.loans, ["gdp"], spark, {"gdp": LayerSpec("gdp", lambda s: ws.macro)})


def q_layer_from_folder(spark, sf_dir):
    """A layer found by listing the folder of stored panels."""
    ws = workspace(spark, sf_dir)
    folder = scratch_path(spark, "layers")
    versions.replace_table(ws.macro, f"{folder}/gdp")
    return apply_layers(ws.loans, list(folder_catalogue(spark, folder)), spark, folder_catalogue(spark, folder))


def q_layer_none(spark, sf_dir):
    return apply_layers(workspace(spark, sf_dir).loans, [])


def q_macro_scan(spark, sf_dir):
    return read_macro(spark, workspace(spark, sf_dir).macro_path)


def q_unparsed_dates(spark, sf_dir):
    return unparsed_dates(workspace(spark, sf_dir).loan_csv)


def fanout_macro(macro: DataFrame) -> DataFrame:
    """The panel plus a non-annual copy of one year and a NULL-frequency copy of another."""
    quarterly = macro.where(F.col("year") == FANOUT_YEAR) \
        .withColumn("gdp_usd", F.col("gdp_usd") / 4).withColumn("frequency", F.lit(FANOUT_FREQUENCY))
    no_freq = macro.where(F.col("year") == NULL_FREQ_YEAR).withColumn("frequency", F.lit(None).cast("string"))
    return macro.unionByName(quarterly).unionByName(no_freq)


def q_macro_layer_fanout(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return layer_macro(ws.loans, fanout_macro(ws.macro))


def q_macro_layer_two(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return apply_layers(ws.loans, [ws.macro, ws.macro])


# ---------------------------------------------------------------- dashboard

def q_filter_borrower_type(spark, sf_dir):
    return portfolio.filter_portfolio(workspace(spark, sf_dir).layered(), borrower_type=FILTER_TYPE)


def q_filter_year(spark, sf_dir):
    return portfolio.filter_portfolio(workspace(spark, sf_dir).layered(), year=FILTER_YEAR)


def q_filter_both(spark, sf_dir):
    return portfolio.filter_portfolio(workspace(spark, sf_dir).layered(), borrower_type=FILTER_TYPE, year=FILTER_YEAR)


def q_distinct_types(spark, sf_dir):
    return portfolio.distinct_values(workspace(spark, sf_dir).layered(), "borrower_type")


def q_distinct_years(spark, sf_dir):
    return portfolio.distinct_values(workspace(spark, sf_dir).layered(), "year", cast="int")


def q_preview_loans(spark, sf_dir):
    return portfolio.preview(workspace(spark, sf_dir).layered(), 100)


def q_portfolio_kpis(spark, sf_dir):
    return round6(portfolio.portfolio_kpis(workspace(spark, sf_dir).layered()), ["default_rate"])


def q_default_distribution(spark, sf_dir):
    return portfolio.default_distribution(workspace(spark, sf_dir).layered())


def q_describe_long(spark, sf_dir):
    d = statistics.describe_long(workspace(spark, sf_dir).layered())
    return round6(d, ["mean", "std", "p25", "p50", "p75"])


def q_monthly_series(spark, sf_dir):
    return round2(round6(portfolio.monthly_series(workspace(spark, sf_dir).layered()), ["default_rate"]), ["total_amount"])


def q_default_rate_by_type(spark, sf_dir):
    return round6(portfolio.default_rate_by(workspace(spark, sf_dir).layered(), "borrower_type"),
                  ["default_rate"])


def q_corr_long(spark, sf_dir):
    return round6(statistics.corr_long(workspace(spark, sf_dir).layered()), ["corr"])


def q_amount_box(spark, sf_dir):
    b = statistics.box_stats(workspace(spark, sf_dir).layered(), "amount", "default_flag")
    return round6(b, ["q1", "median", "q3"])


def q_macro_box(spark, sf_dir):
    layered = workspace(spark, sf_dir).layered()
    var = statistics.macro_columns(layered)[0]
    b = statistics.box_stats(layered, var, "default_flag")
    return round6(b, ["q1", "median", "q3"])


def q_amount_kde(spark, sf_dir):
    """The density of a continuous column."""
    k = density.kde(workspace(spark, sf_dir).layered(), "amount", "borrower_type")
    return k.withColumns({"x": F.round("x", 3), "density": F.round(F.col("density") * 1e6, 6)})


def q_tenure_kde(spark, sf_dir):
    k = density.kde(workspace(spark, sf_dir).layered(), "tenure_days", "default_flag")
    return round6(k, ["x", "density"])


# ---------------------------------------------------------------- features and models

# Model sizes of the registered model queries; depths are the models' own.
REGISTRY_GBT = {"max_iter": 100}
REGISTRY_RF = {"num_trees": 100}
# Deterministic score standing in for a model in the SQL-checked queries.
FIXED_PD_DAYS = 1000.0
LGD_PCT = 45


def fixed_pd() -> F.Column:
    return F.least(F.lit(1.0), F.col("tenure_days") / F.lit(FIXED_PD_DAYS))


def _split_rows(spark, sf_dir):
    return features.with_split(features.training_rows(workspace(spark, sf_dir).layered()))


def q_train_rows(spark, sf_dir):
    return features.training_rows(workspace(spark, sf_dir).layered())


def q_train_test_split(spark, sf_dir):
    return _split_rows(spark, sf_dir).select("loan_no", features.IS_TEST)


def q_train_test_split_exact(spark, sf_dir):
    rows = features.training_rows(workspace(spark, sf_dir).layered())
    return features.with_exact_split(rows).select("loan_no", features.IS_TEST)


def q_impute_stats(spark, sf_dir):
    prep = workspace(spark, sf_dir).prepared[0]
    return round6(features.stats_frame(prep, spark).select("variable", "median"), ["median"])


def q_scale_stats(spark, sf_dir):
    prep = workspace(spark, sf_dir).prepared[0]
    return round6(features.stats_frame(prep, spark).select("variable", "mean", "std"), ["mean", "std"])


def q_category_vocab(spark, sf_dir):
    return features.vocab_frame(workspace(spark, sf_dir).prepared[0], spark)


def q_scaled_features(spark, sf_dir):
    prep = workspace(spark, sf_dir).prepared[0]
    return round6(features.scaled_long(_split_rows(spark, sf_dir), prep), ["value"])


def q_onehot_long(spark, sf_dir):
    prep = workspace(spark, sf_dir).prepared[0]
    return features.onehot_long(_split_rows(spark, sf_dir), prep)


def q_feature_matrix(spark, sf_dir):
    prep, train, test, _ = workspace(spark, sf_dir).prepared
    both = train.select("loan_no", features.FEATURES).unionByName(test.select("loan_no", features.FEATURES))
    return round6(features.matrix_long(both, prep.feature_names), ["value"])


def q_binary_metrics(spark, sf_dir):
    test = _split_rows(spark, sf_dir).where(F.col(features.IS_TEST))
    scored = test.select("label", (fixed_pd() > 0.5).cast("int").alias("prediction"))
    return round6(models.confusion_metrics(scored), ["accuracy", "precision", "recall"])


def q_expected_loss(spark, sf_dir):
    test = _split_rows(spark, sf_dir).where(F.col(features.IS_TEST))
    # pd and el are the same IEEE products in any engine: not rounded.
    return risk.expected_loss(test.withColumn("pd", fixed_pd()), "pd", LGD_PCT)


def q_expected_loss_totals(spark, sf_dir):
    test = _split_rows(spark, sf_dir).where(F.col(features.IS_TEST))
    el = risk.expected_loss(test.withColumn("pd", fixed_pd()), "pd", LGD_PCT)
    return round2(round6(risk.expected_loss_totals(el), ["el_rate"]), ["total_ead", "total_el"])


def q_export_roundtrip(spark, sf_dir):
    layered = workspace(spark, sf_dir).layered()
    path = sinks.export_csv(layered, scratch_path(spark, "export"))
    return sinks.read_export(spark, path, layered.schema)


def q_gbt_scores(spark, sf_dir):
    return workspace(spark, sf_dir).model(models.BOOSTED, **REGISTRY_GBT).score()


def q_rf_scores(spark, sf_dir):
    return workspace(spark, sf_dir).model(models.FOREST, **REGISTRY_RF).score()


def q_model_metrics(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    return ws.model(models.BOOSTED, **REGISTRY_GBT).metrics().unionByName(
        ws.model(models.FOREST, **REGISTRY_RF).metrics())


def q_model_expected_loss(spark, sf_dir):
    scored = workspace(spark, sf_dir).model(models.BOOSTED, **REGISTRY_GBT).score()
    return risk.expected_loss(scored, "pd", LGD_PCT)


def _shap(spark, sf_dir, name, params):
    m = workspace(spark, sf_dir).model(name, **params)
    return explain.shap_values(m.model, m.test, m.feature_names, m.key)


def q_shap_values(spark, sf_dir):
    return _shap(spark, sf_dir, models.BOOSTED, REGISTRY_GBT)


def q_shap_top10(spark, sf_dir):
    return explain.top_features(_shap(spark, sf_dir, models.BOOSTED, REGISTRY_GBT))


def q_rf_shap_top10(spark, sf_dir):
    return explain.top_features(_shap(spark, sf_dir, models.FOREST, REGISTRY_RF))


def q_shap_summary(spark, sf_dir):
    m = workspace(spark, sf_dir).model(models.BOOSTED, **REGISTRY_GBT)
    return explain.summary(explain.shap_values(m.model, m.test, m.feature_names, m.key, with_value=True))


def q_rf_expected_loss_totals(spark, sf_dir):
    scored = workspace(spark, sf_dir).model(models.FOREST, **REGISTRY_RF).score()
    return risk.expected_loss_totals(risk.expected_loss(scored, "pd", LGD_PCT))


# A small ensemble over tenure, amount and year with stated covers:
# (tree, id, left, right, feature, threshold, cover, value).
FIXED_FEATURES = ("tenure_days", "amount", "year")
FIXED_NODES = [
    (0, 0, 1, 2, 0, 180.0, 100.0, 0.0), (0, 1, 3, 4, 1, 150000.0, 60.0, 0.0), (0, 2, 5, 6, 1, 300000.0, 40.0, 0.0),
    (0, 3, -1, -1, None, None, 35.0, 0.05), (0, 4, -1, -1, None, None, 25.0, 0.2),
    (0, 5, -1, -1, None, None, 22.0, 0.3), (0, 6, -1, -1, None, None, 18.0, 0.9),
    (1, 0, 1, 2, 2, 1997.0, 80.0, 0.0), (1, 1, -1, -1, None, None, 30.0, 0.1), (1, 2, 3, 4, 0, 90.0, 50.0, 0.0),
    (1, 3, -1, -1, None, None, 20.0, 0.15), (1, 4, -1, -1, None, None, 30.0, 0.4)]


def _fixed_ensemble(spark, sf_dir):
    """(node table, test rows with their raw features, missing ones as 0)."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in FIXED_FEATURES])
    rows = _split_rows(spark, sf_dir).where(F.col(features.IS_TEST)).select("loan_no", x.alias("x"))
    return spark.createDataFrame(FIXED_NODES, explain.NODES), rows


def q_score_fixed_ensemble(spark, sf_dir):
    nodes, rows = _fixed_ensemble(spark, sf_dir)
    return round6(explain.score_nodes(nodes, rows, "x"), ["score"])


def q_shap_fixed_tree(spark, sf_dir):
    nodes, rows = _fixed_ensemble(spark, sf_dir)
    return round6(explain.explain_nodes(nodes, rows, FIXED_FEATURES, features="x"), ["phi"])


def q_newton_stump(spark, sf_dir):
    """The first split of the boosted trees on tenure and year: its leaves in closed form."""
    rows = _split_rows(spark, sf_dir).where(~F.col(features.IS_TEST) & F.col("year").isNotNull())
    train = rows.select(F.array(F.col("tenure_days").cast("double"), F.col("year").cast("double")).alias("x"), "label")
    model = boosting.NewtonBoosting(max_iter=1, max_depth=1, features="features").fit(
        train.select(array_to_vector("x").alias("features"), "label"))
    names = F.array(F.lit("tenure_days"), F.lit("year"))
    kinds = F.when(F.col("tree") == 0, "base").when(F.col("left") >= 0, "split").when(F.col("id") == 1, "left").otherwise("right")
    return round6(model.nodes.select(kinds.alias("node"), F.get(names, F.col("feature")).alias("feature"), "threshold",
                                     "cover", F.when(F.col("left") < 0, F.col("value")).alias("value")), ["cover", "value"])


# Rows shown in the scored-loan table (a display limit, ordered by loan number).
EL_DISPLAY_ROWS = 50


def q_expected_loss_preview(spark, sf_dir):
    return q_expected_loss(spark, sf_dir).orderBy("loan_no").limit(EL_DISPLAY_ROWS)


def q_model_expected_loss_totals(spark, sf_dir):
    return risk.expected_loss_totals(q_model_expected_loss(spark, sf_dir))


def q_model_runs(spark, sf_dir):
    """Both models through the dispatcher on one shared split and preparation."""
    ws = workspace(spark, sf_dir)
    runs = models.run_models(ws.layered(), [models.BOOSTED, models.FOREST], {models.BOOSTED: REGISTRY_GBT, models.FOREST: REGISTRY_RF}, ws.model)
    out = None
    for name, m in runs.items():
        s = m.score().select(F.lit(name).alias("model"), "loan_no", "label", "prediction", "pd")
        out = s if out is None else out.unionByName(s)
    return out


# ---------------------------------------------------------------- filtered dashboard

def q_sme_monthly_series(spark, sf_dir):
    """The time-series widget over the borrower-type filtered portfolio."""
    f = portfolio.filter_portfolio(workspace(spark, sf_dir).layered(), borrower_type=FILTER_TYPE)
    return round2(round6(portfolio.monthly_series(f), ["default_rate"]), ["total_amount"])


def q_year_rate_by_type(spark, sf_dir):
    """The categorical widget over the year filtered portfolio."""
    f = portfolio.filter_portfolio(workspace(spark, sf_dir).layered(), year=FILTER_YEAR)
    return round6(portfolio.default_rate_by(f, "borrower_type"), ["default_rate"])


# All numeric columns of the layered panel, ids included: wide enough for the
# batched Gramian form of the correlation.
WIDE_CORR_COLUMNS = ("loan_no", "borrower_id", "tenure_days", "amount", "default_flag", "year", "gdp_usd")


def q_corr_wide(spark, sf_dir):
    return round6(statistics.corr_long(workspace(spark, sf_dir).layered(), WIDE_CORR_COLUMNS), ["corr"])


def q_corr_unlayered(spark, sf_dir):
    """The heatmap when no macro layer is chosen: the loan panel's own numeric columns."""
    return round6(statistics.corr_long(workspace(spark, sf_dir).loans), ["corr"])


QUERIES: dict[str, Query] = {
    # sources
    "loan_panel": q_loan_panel,
    "loan_csv_ingest": q_loan_csv_ingest,
    "rejected_records": q_rejected_records,
    "parse_dates": q_parse_dates,
    "tagged_loans": q_tagged_loans,
    "country_lookup": q_country_lookup,
    "replaced_lookup": q_replaced_lookup,
    "macro_wide": q_macro_wide,
    "macro_panel": q_macro_panel,
    # layering
    "macro_layer": q_macro_layer,
    "macro_layer_fanout": q_macro_layer_fanout,
    "macro_layer_two": q_macro_layer_two,
    "layer_by_name": q_layer_by_name,
    "layer_from_folder": q_layer_from_folder,
    "layer_none": q_layer_none,
    "macro_scan": q_macro_scan,
    "unparsed_dates": q_unparsed_dates,
    # dashboard
    "filter_borrower_type": q_filter_borrower_type,
    "filter_year": q_filter_year,
    "filter_both": q_filter_both,
    "distinct_types": q_distinct_types,
    "distinct_years": q_distinct_years,
    "preview_loans": q_preview_loans,
    "portfolio_kpis": q_portfolio_kpis,
    "default_distribution": q_default_distribution,
    "describe_long": q_describe_long,
    "monthly_series": q_monthly_series,
    "default_rate_by_type": q_default_rate_by_type,
    "corr_long": q_corr_long,
    "corr_wide": q_corr_wide,
    "corr_unlayered": q_corr_unlayered,
    "amount_box": q_amount_box,
    "macro_box": q_macro_box,
    "tenure_kde": q_tenure_kde,
    "amount_kde": q_amount_kde,
    "sme_monthly_series": q_sme_monthly_series,
    "year_rate_by_type": q_year_rate_by_type,
    # features, metrics, risk, export
    "train_rows": q_train_rows,
    "train_test_split": q_train_test_split,
    "train_test_split_exact": q_train_test_split_exact,
    "impute_stats": q_impute_stats,
    "scale_stats": q_scale_stats,
    "category_vocab": q_category_vocab,
    "scaled_features": q_scaled_features,
    "onehot_long": q_onehot_long,
    "feature_matrix": q_feature_matrix,
    "binary_metrics": q_binary_metrics,
    "score_fixed_ensemble": q_score_fixed_ensemble,
    "shap_fixed_tree": q_shap_fixed_tree,
    "newton_stump": q_newton_stump,
    "expected_loss": q_expected_loss,
    "expected_loss_preview": q_expected_loss_preview,
    "expected_loss_totals": q_expected_loss_totals,
    "export_roundtrip": q_export_roundtrip,
    # models and attributions (rows-only checks)
    "gbt_scores": q_gbt_scores,
    "rf_scores": q_rf_scores,
    "model_runs": q_model_runs,
    "model_metrics": q_model_metrics,
    "model_expected_loss": q_model_expected_loss,
    "model_expected_loss_totals": q_model_expected_loss_totals,
    "shap_values": q_shap_values,
    "rf_expected_loss_totals": q_rf_expected_loss_totals,
    "shap_summary": q_shap_summary,
    "shap_top10": q_shap_top10,
    "rf_shap_top10": q_rf_shap_top10,
}
