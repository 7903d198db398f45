import pytest
from pyspark.sql import functions as F

from riskweave.operators import explain, models, risk
from riskweave.plans.workspace import workspace


def test_confusion_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)], "label int, prediction int")
    r = models.confusion_metrics(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 2, 1)
    assert (r.accuracy, r.precision, r.recall) == (0.6, 0.5, 0.5)
    none = models.confusion_metrics(df.where("prediction = 0 AND label = 0")).first()
    assert (none.precision, none.recall, none.accuracy) == (0.0, 0.0, 1.0)


def test_single_class_and_missing_target(spark):
    df = spark.createDataFrame([(i, float(i), 0.0) for i in range(50)], "loan_no bigint, amount double, default_flag double")
    with pytest.raises(ValueError, match="single class"):
        models.train_and_evaluate(df, "XGBoost", max_iter=2)
    with pytest.raises(ValueError, match="default_flag"):
        models.train_and_evaluate(df.drop("default_flag"), "XGBoost")
    with pytest.raises(ValueError, match="unknown model"):
        models.train_and_evaluate(df, "SVM")


@pytest.fixture(scope="module")
def trained(spark, small_sf):
    ws = workspace(spark, small_sf)
    return ws, {n: ws.model(n, **p) for n, p in (("XGBoost", {"max_iter": 10}), ("Random Forest", {"num_trees": 10}))}


def test_models_beat_majority_and_explain(trained, spark):
    ws, ms = trained
    for name, m in ms.items():
        scored = m.score()
        r = m.metrics().first()
        labels = scored.agg(F.avg("label").alias("p"), F.count("*").alias("n")).first()
        majority = max(labels.p, 1 - labels.p)
        assert r.accuracy > majority, name
        assert scored.where((F.col("pd") < 0) | (F.col("pd") > 1)).count() == 0
        # attributions add up to the model output
        nodes, kind = explain.known_nodes(m.model, spark)
        base = explain.base_value(nodes)
        sh = explain.shap_values(m.model, m.test, m.feature_names, m.key)
        tot = sh.groupBy("loan_no").agg(F.sum("phi").alias("s"))
        p = F.col("pd")
        target = F.log(p / (1 - p)) if kind == "log_odds" else p
        err = tot.join(scored, "loan_no").select(F.max(F.abs(F.col("s") + base - target))).first()[0]
        assert err < 1e-6, name
        assert sh.count() == scored.count() * len(m.feature_names)
        top = explain.top_features(sh).collect()
        assert len(top) == min(10, len(m.feature_names))
        assert top[0].mean_abs_phi >= top[-1].mean_abs_phi


def test_expected_loss(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 0.1), (2, 2, None, 0.5), (3, 3, 50.0, 1.0)],
                               "borrower_id int, loan_no int, amount double, pd double")
    el = risk.expected_loss(df, "pd", 50)
    got = {r.loan_no: r.el for r in el.collect()}
    assert got == {1: pytest.approx(5.0), 2: None, 3: pytest.approx(25.0)}
    t = risk.expected_loss_totals(el).first()
    assert (t.total_ead, t.total_el) == (150.0, 30.0) and t.el_rate == pytest.approx(20.0)
    zero = risk.expected_loss_totals(risk.expected_loss(df.where("amount IS NULL"), "pd")).first()
    assert (zero.total_ead, zero.total_el, zero.el_rate) == (0.0, 0.0, 0.0)
    for bad in (5, 47, 105):
        with pytest.raises(ValueError):
            risk.lgd_fraction(bad)


def test_dispatcher_shares_split(trained):
    ws, ms = trained
    keys = [sorted(r.loan_no for r in m.score().select("loan_no").collect()) for m in ms.values()]
    assert keys[0] == keys[1] and len(keys[0]) > 0
    assert set(models.MODELS) == {models.BOOSTED, models.FIRST_ORDER, models.FOREST}
    assert models.model_name("XGBoost Classifier") == models.model_name("XGBoost") == models.BOOSTED


def test_no_feature_columns(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(20)], "loan_no bigint, default_flag double")
    with pytest.raises(ValueError, match="no feature columns"):
        models.train_and_evaluate(df, "XGBoost", max_iter=2)


def test_registered_forest_grows_to_the_default_depth(spark):
    from riskweave.plans import registry
    assert models.random_forest(**registry.REGISTRY_RF).max_depth is None  # no limit
