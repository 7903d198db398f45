"""Default models: registry, training, scoring and evaluation.

``train_and_evaluate(df, name)`` follows the original flow: training rows,
deterministic 80/20 split, feature preparation fitted on the training side,
a tree ensemble from Spark ML, then probability of default and class
prediction for the test side and the three quality metrics.

Scale notes:
* the prepared training set is persisted (memory and disk) because tree
  learning reads it once per level and iteration; it is unpersisted by
  ``TrainedModel.release``;
* boosted trees take one job per level: tasks add up histograms, the driver
  sees one best split per open node and feature (riskweave.operators.boosting);
* the forest splits nodes too large for a task by histograms of all trees at
  once, and is finished by one task per lower node (riskweave.operators.forest);
* node-id caching and checkpoints (to the shared checkpoint folder) keep
  the lineage of deep or long boosting runs short.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators.features import (FEATURES, IS_TEST, LABEL, FeatureSpec, FittedPrep, feature_spec,
                                          fit_prep, row_key, training_rows, with_split)
from riskweave.operators.boosting import NewtonBoosting
from riskweave.operators.forest import LocalForest, TreeModel
from riskweave.session import checkpoint_dir

PD = "pd"
PREDICTION = "prediction"
SEED = 42
# Split candidates per feature.
MAX_BINS = 256


# Node-id caching pays off only for deep trees (shallow trees are cheaper to ship).
NODE_CACHE_MIN_DEPTH = 9


def gbt(max_iter: int = 100, max_depth: int = 6, step_size: float = 0.3, reg_lambda: float = 1.0) -> NewtonBoosting:
    """Boosted trees with the original library's defaults (100 rounds, depth
    6, rate 0.3, L2 term 1): second-order steps."""
    return NewtonBoosting(max_iter=max_iter, max_depth=max_depth, step_size=step_size, reg_lambda=reg_lambda, features=FEATURES, label=LABEL)


def first_order_gbt(max_iter: int = 100, max_depth: int = 6, step_size: float = 0.3, seed: int = SEED) -> GBTClassifier:
    """Spark ML's boosted trees (first-order steps, no L2 term).

    ``checkpointInterval`` also checkpoints the running predictions every 10
    rounds, which keeps the lineage of long boosting runs short."""
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step_size, seed=seed, lossType="logistic",
                         cacheNodeIds=max_depth >= NODE_CACHE_MIN_DEPTH, checkpointInterval=10, maxBins=MAX_BINS)


def random_forest(num_trees: int = 100, max_depth: int | None = None, seed: int = SEED) -> LocalForest:
    """Random forest: 100 trees, sqrt features per split, bootstrap, no depth limit."""
    return LocalForest(num_trees=num_trees, max_depth=max_depth, seed=seed, features=FEATURES, label=LABEL)


BOOSTED, FIRST_ORDER, FOREST = "Gradient Boosted Trees", "First-order Boosted Trees", "Random Forest"
MODELS: dict[str, Callable[..., object]] = {BOOSTED: gbt, FIRST_ORDER: first_order_gbt, FOREST: random_forest}
# FIXED VALUES: other names that callers use for the models.
ALIASES = {"XGBoost": BOOSTED, "XGBoost Classifier": BOOSTED, "Random Forest Classifier": FOREST}


def model_name(name: str) -> str:
    """The registered name behind ``name``; unknown names raise."""
    known = ALIASES.get(name, name)
    if known not in MODELS:
        raise ValueError(f"unknown model {name!r}; choose from {sorted([*MODELS, *ALIASES])}")
    return known


def confusion_metrics(scored: DataFrame, label: str = LABEL, prediction: str = PREDICTION) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision and recall of class 1 in one
    aggregate; an undefined ratio (no predicted or no actual positive) is 0."""
    p, y = F.col(prediction).cast("int"), F.col(label).cast("int")
    c = scored.agg(F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
                   F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn"))

    def ratio(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))

    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("tp", "fp", "tn", "fn",
                    ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"))


@dataclass
class TrainedModel:
    name: str
    model: object
    prep: FittedPrep
    key: str
    train: DataFrame
    test: DataFrame  # prepared test rows: key, label, passthrough columns, features
    passthrough: tuple[str, ...] = ()
    _scored: DataFrame | None = field(default=None, repr=False)

    @property
    def feature_names(self) -> list[str]:
        return self.prep.feature_names

    def score(self, df: DataFrame | None = None) -> DataFrame:
        """key, label, prediction and ``pd`` (probability of class 1)."""
        if df is None and self._scored is not None:
            return self._scored
        prepared = self.test if df is None else df
        columns = [self.key, *self.passthrough, LABEL]
        if isinstance(self.model, TreeModel):
            scored = self.model.scored(prepared.select(*columns, FEATURES), FEATURES, PD)
            out = scored.select(*columns, (F.col(PD) > 0.5).cast("int").alias(PREDICTION), PD)
        else:
            out = self.model.transform(prepared).select(*columns, F.col(PREDICTION).cast("int").alias(PREDICTION),
                                                        vector_to_array("probability")[1].alias(PD))
        if df is None:
            self._scored = out
        return out

    def metrics(self) -> DataFrame:
        return confusion_metrics(self.score()).select(F.lit(self.name).alias("model"), "*")

    def release(self) -> None:
        self.train.unpersist()


# Loan columns carried next to the scores (for the expected-loss table).
PASSTHROUGH = ("borrower_id", "amount")


def prepare(df: DataFrame, key: str = "loan_no", include_year: str | bool = "auto",
            spec: FeatureSpec | None = None,
            passthrough: tuple[str, ...] = PASSTHROUGH) -> tuple[FittedPrep, DataFrame, DataFrame, tuple[str, ...]]:
    """Training rows -> (fitted prep, prepared train, prepared test, passthrough columns)."""
    # What is a feature is settled on all rows, labelled or not.
    spec = spec or feature_spec(df, include_year)
    if key not in df.columns:
        df = df.withColumn(key, F.md5(row_key(df, key)))
    rows = with_split(training_rows(df), key)
    train_src = rows.where(~F.col(IS_TEST))
    prep = fit_prep(train_src, spec)
    if not prep.feature_names:
        raise ValueError("no feature columns: numeric or text columns besides ids and the target are needed")
    carried = tuple(c for c in passthrough if c in df.columns and c != key)
    train = prep.transform(train_src, [key, LABEL])
    test = prep.transform(rows.where(F.col(IS_TEST)), [key, *carried, LABEL])
    return prep, train, test, carried


def train_and_evaluate(df: DataFrame, name: str = BOOSTED, key: str = "loan_no",
                       include_year: str | bool = "auto", prepared: tuple | None = None,
                       **params) -> TrainedModel:
    """Fit model ``name`` from :data:`MODELS` on the training side of ``df``.

    ``prepared`` reuses the result of :func:`prepare` (so several models
    share one split and one fitted preparation)."""
    name = model_name(name)
    checkpoint_dir(df.sparkSession)
    prep, train, test, carried = prepared or prepare(df, key, include_year)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    classes = train.groupBy(LABEL).count().limit(3).collect()
    if len(classes) < 2:
        train.unpersist()
        raise ValueError("training rows hold a single class; both 0 and 1 are needed")
    model = MODELS[name](**params).fit(train)
    return TrainedModel(name, model, prep, key, train, test, carried)


def run_models(df: DataFrame, names: list[str], params: dict[str, dict] | None = None,
               train: Callable[..., TrainedModel] | None = None) -> dict[str, TrainedModel]:
    """Train every selected model (the dispatcher); ``params`` holds optional
    keyword arguments per model name. All share one split and preparation of
    ``df``, unless ``train(name, **params)`` says how a model is trained."""
    params, known = params or {}, {n: model_name(n) for n in names}
    if train is None:
        prepared = prepare(df)
        train = lambda name, **p: train_and_evaluate(df, name, prepared=prepared, **p)
    return {n: train(m, **params.get(n, {})) for n, m in known.items()}
