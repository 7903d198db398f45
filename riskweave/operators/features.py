"""Model inputs: training rows, a deterministic train/test split, and the
fitted feature preparation (median impute -> standardise for numbers,
'missing' fill -> one-hot for categories), assembled into one vector.

Everything is fitted on the training rows only and applied to both sides.
The fitted state is computed by distributed aggregates: one statistic per
column, which reaches the driver, and one vocabulary per categorical column,
which stays a table. Applying it is a projection of built-in column
expressions, one join per categorical column (a broadcast unless the
vocabulary is large) and ``VectorAssembler``.

Scale notes:
* medians are exact (average of the middle pair) through
  :func:`riskweave.functions.quantiles.exact_quantiles`, which never holds
  a whole column in one task;
* a category finds its one-hot place by a join with the vocabulary, and the
  vector is sparse, so that the cost per row does not grow with it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.quantiles import exact_quantiles
from riskweave.schema import (LEAKAGE_COLUMNS, MISSING_CATEGORY, SPLIT_SEED, TEST_SHARE_PCT,
                              is_feature_categorical, is_feature_numeric)
from riskweave.session import scratch_path

TARGET = "default_flag"
LABEL = "label"
IS_TEST = "is_test"
FEATURES = "features"


def require_target(df: DataFrame, target: str = TARGET) -> None:
    """Schema check only: training needs the target column."""
    if target not in df.columns:
        raise ValueError(f"'{target}' column missing: cannot train a model")


def training_rows(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows with a known target, plus the integer ``label`` (truncating cast)."""
    require_target(df, target)
    return df.where(F.col(target).isNotNull()).withColumn(LABEL, F.col(target).cast("int"))


def split_flag(key: str | Column = "loan_no", seed: int = SPLIT_SEED,
               test_pct: int = TEST_SHARE_PCT) -> Column:
    """True for test rows: the first 32 bits of md5('<key>:<seed>') mod 100 < test_pct.

    Depends only on the key, so it is stable under any repartitioning,
    identical in other SQL engines, and duplicated loans land on one side.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(k.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10)
    return (h.cast("bigint") % 100) < test_pct


def row_key(df: DataFrame, key: str) -> Column:
    """``key`` as text; a NULL one, or all without the column, by the whole row."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    return F.coalesce(F.col(key).cast("string"), row) if key in df.columns else row


def with_split(df: DataFrame, key: str = "loan_no", **kwargs) -> DataFrame:
    """Every row gets a side; rows without a key by a hash of all they hold."""
    return df.withColumn(IS_TEST, split_flag(row_key(df, key), **kwargs))


def with_exact_split(df: DataFrame, key: str = "loan_no", seed: int = SPLIT_SEED, test_pct: int = TEST_SHARE_PCT) -> DataFrame:
    """Every row gets a side so that ceil(test_pct / 100 * n) rows are test
    rows, as in the original split: those with the smallest hashes (52 bits
    of md5('<key>:<seed>')). The cut is an exact order statistic of the
    hashes, found without sorting them; it is one number. Rows that share a
    key share the side, so a key that repeats at the cut can exceed the size."""
    text = F.concat(row_key(df, key), F.lit(f":{seed}"))
    hashed = df.withColumn("__hash", F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint"))
    rank = lambda p, n: F.floor((n * test_pct + 99) / 100) - 1
    cut = exact_quantiles(hashed, "__hash", [test_pct / 100], place=rank).first()
    limit = F.lit(-1 if cut is None or test_pct <= 0 else int(cut["q0"]))
    return hashed.withColumn(IS_TEST, F.col("__hash") <= limit).drop("__hash")


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]


def feature_spec(df: DataFrame, include_year: str | bool = "auto",
                 drop: Sequence[str] = LEAKAGE_COLUMNS) -> FeatureSpec:
    """Feature columns by type, after dropping ids and leakage columns.

    64-bit integers and doubles are numeric, strings categorical, all other
    types are left out. ``year`` (a 32-bit int here) follows
    ``include_year``: 'auto' keeps it only when some value is missing,
    which is when the original application ends up with a float year and
    so treats it as a feature.
    """
    kept = [f for f in df.schema.fields if f.name not in drop and f.name not in (LABEL, IS_TEST)]
    numeric = [f.name for f in kept if is_feature_numeric(f.dataType)]
    categorical = [f.name for f in kept if is_feature_categorical(f.dataType)]
    if "year" in df.columns and "year" not in numeric and "year" not in drop:
        use_year = include_year
        if include_year == "auto":
            use_year = df.where(F.col("year").isNull()).limit(1).count() > 0
        if use_year:
            order = [f.name for f in kept]
            numeric = sorted(numeric + ["year"], key=order.index)
    return FeatureSpec(tuple(numeric), tuple(categorical))


def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("kv")).select("kv.variable", "kv.value")


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_CATEGORY))


@dataclass
class FittedPrep:
    """Frozen statistics of the feature preparation."""
    spec: FeatureSpec
    medians: dict[str, float]
    means: dict[str, float]
    scales: dict[str, float]
    # (variable, category, idx) as a stored table, and its rows per column.
    vocab: DataFrame | None = None
    sizes: dict[str, int] = field(default_factory=dict)

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.spec.numeric if c in self.medians]

    @property
    def width(self) -> int:
        """Length of the feature vector."""
        return len(self.numeric) + sum(self.sizes.values())

    @property
    def feature_names(self) -> list[str]:
        """One name per place of the vector. The categories are read for it:
        only who names single features (reports, attributions) asks."""
        names = [f"num__{c}" for c in self.numeric]
        places: dict[str, list[str]] = {c: [""] * n for c, n in self.sizes.items()}
        if self.width > len(names):
            for r in self.vocab.collect():
                places[r["variable"]][r["idx"]] = r["category"]
        return names + [f"cat__{c}_{v}" for c in self.spec.categorical for v in places[c]]

    def scaled(self, c: str) -> Column:
        x = F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c]))
        return (x - F.lit(self.means[c])) / F.lit(self.scales[c])

    def indexed(self, df: DataFrame, source: dict[str, str]) -> DataFrame:
        """``df`` with, for each categorical column, the column ``source[c]``
        (filled text) and the place of its category, ``source[c]``_i; a
        category not in the vocabulary has the place after the last. The
        vocabulary is joined by category (broadcast if the optimizer finds
        it small)."""
        for c, text in source.items():
            known = self.vocab.where(F.col("variable") == c).select(F.col("category").alias(f"{text}_k"), F.col("idx").alias(f"{text}_x"))
            kinds = {"ml_attr": {"type": "nominal", "num_vals": self.sizes[c] + 1}}
            df = df.withColumn(text, _filled(c)).join(known, F.col(text) == F.col(f"{text}_k"), "left")
            place = F.coalesce(F.col(f"{text}_x"), F.lit(self.sizes[c])).cast("double").alias(f"{text}_i", metadata=kinds)
            df = df.select(*[x for x in df.columns if x not in (f"{text}_k", f"{text}_x")], place)
        return df

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus the assembled ``features`` vector (narrow);
        an unknown category is all zeros."""
        source = {c: f"__c{i}" for i, c in enumerate(self.spec.categorical) if self.sizes[c]}
        numbers = [f"__f{i}" for i in range(len(self.numeric))]
        flat = self.indexed(df.withColumns({t: self.scaled(c) for t, c in zip(numbers, self.numeric)}), source)
        inputs = list(numbers)
        if source:
            encoder = OneHotEncoder(inputCols=[f"{t}_i" for t in source.values()], outputCols=[f"{t}_v" for t in source.values()], dropLast=True)
            flat = encoder.fit(flat).transform(flat)  # sizes are in the columns' metadata: no job
            inputs += [f"{t}_v" for t in source.values()]
        out = VectorAssembler(inputCols=inputs, outputCol=FEATURES).transform(flat)
        # Only the width is told to the learners: every entry is a number, also a 0 or 1.
        width = {"ml_attr": {"num_attrs": self.width}}
        return out.select(*keep, F.col(FEATURES).alias(FEATURES, metadata=width))


def fit_prep(train: DataFrame, spec: FeatureSpec) -> FittedPrep:
    """Fit medians, means/population deviations and vocabularies on ``train``.

    Numeric branch: exact medians of all numeric columns at once, then one
    aggregate of the means and population deviations of the imputed
    columns (computed on the imputed values themselves, the same sums any
    other engine forms). A column with no value in training is dropped, as
    the original imputer does.

    Categorical branch: distinct (column, category) pairs, numbered in sorted
    order and stored as a table; the driver holds their number per column.
    """
    medians: dict[str, float] = {}
    if spec.numeric:
        q = exact_quantiles(_long_numeric(train, spec.numeric), "value", [0.5], by=["variable"])
        medians = {r["variable"]: float(r["q0"]) for r in q.collect()}
    num = [c for c in spec.numeric if c in medians]
    means: dict[str, float] = {}
    scales: dict[str, float] = {}
    if num:
        aggs = []
        for c in num:
            x = F.coalesce(F.col(c).cast("double"), F.lit(medians[c]))
            aggs += [F.avg(x).alias(f"m_{c}"), F.var_pop(x).alias(f"v_{c}"), (F.min(x) < F.max(x)).alias(f"d_{c}")]
        row = train.agg(*aggs).first()
        for c in num:
            means[c] = float(row[f"m_{c}"])
            var = float(row[f"v_{c}"] or 0.0)
            scales[c] = var ** 0.5 if row[f"d_{c}"] and var > 0 else 1.0  # a constant column is not rescaled
    vocab, sizes = None, {c: 0 for c in spec.categorical}
    if spec.categorical:
        pairs = (train.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("variable"), _filled(c).alias("category")) for c in spec.categorical]))
            .alias("kv")).select("kv.variable", "kv.category").distinct())
        vocab = sorted_index(pairs)
        sizes |= {r["variable"]: r["n"] for r in vocab.groupBy("variable").agg(F.count("*").alias("n")).collect()}
    return FittedPrep(spec, medians, means, scales, vocab, sizes)


def sorted_index(pairs: DataFrame) -> DataFrame:
    """(variable, category, idx) of distinct ``pairs``: idx counts the
    categories of a variable in sorted order from 0. The pairs are sorted by
    ranges over all tasks; a range adds what the ranges before it hold (one
    small row per range and variable). The result is a stored table."""
    spark = pairs.sparkSession
    path, out = scratch_path(spark, "categories"), scratch_path(spark, "vocabulary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartitionByRange(parts, "variable", "category").sortWithinPartitions("variable", "category")
    # The lower 33 bits of the id count the rows of a partition.
    place = F.monotonically_increasing_id()
    dealt.select("variable", "category", F.spark_partition_id().alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).write.parquet(path)
    rows = spark.read.parquet(path)
    held = rows.groupBy("variable", "range").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("variable").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = held.select("variable", "range", (before - F.col("first")).alias("offset"))
    rows.join(offsets, ["variable", "range"]).select("variable", "category", (F.col("place") + F.col("offset")).cast("int").alias("idx")).write.parquet(out)
    return spark.read.parquet(out)


def stats_frame(prep: FittedPrep, spark) -> DataFrame:
    """(variable, median, mean, std) of the numeric branch."""
    rows = [(c, prep.medians[c], prep.means[c], prep.scales[c]) for c in prep.numeric]
    return spark.createDataFrame(rows, "variable string, median double, mean double, std double")


def vocab_frame(prep: FittedPrep, spark) -> DataFrame:
    """(variable, category, idx) of the categorical branch, idx in sorted order."""
    return spark.createDataFrame([], "variable string, category string, idx int") if prep.vocab is None else prep.vocab


def scaled_long(df: DataFrame, prep: FittedPrep, key: str = "loan_no") -> DataFrame:
    """(key, variable, value): imputed and standardised numeric features."""
    return df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), prep.scaled(c).alias("value")) for c in prep.numeric]))
        .alias("kv")).select(key, "kv.variable", "kv.value")


def onehot_long(df: DataFrame, prep: FittedPrep, key: str = "loan_no") -> DataFrame:
    """(key, variable, category, idx): the filled category and its one-hot
    position; idx is NULL for a category unseen in training (all zeros)."""
    source = {c: f"__c{i}" for i, c in enumerate(prep.spec.categorical)}
    out = [F.struct(F.lit(c).alias("variable"), F.col(t).alias("category"),
                    F.when(F.col(f"{t}_i") < prep.sizes[c], F.col(f"{t}_i").cast("int")).alias("idx")) for c, t in source.items()]
    return prep.indexed(df, source).select(key, F.explode(F.array(*out)).alias("kv")) \
        .select(key, "kv.variable", "kv.category", "kv.idx")


def matrix_long(prepared: DataFrame, names: Sequence[str], key: str = "loan_no") -> DataFrame:
    """(key, feature, value) of every entry of the assembled vector."""
    from pyspark.ml.functions import vector_to_array
    name_arr = F.array(*[F.lit(n) for n in names])
    return (prepared.select(key, F.posexplode(vector_to_array(FEATURES)).alias("pos", "value"))
            .select(key, F.element_at(name_arr, F.col("pos") + 1).alias("feature"), "value"))
