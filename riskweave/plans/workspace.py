"""Per-(session, data folder) workspace: the derived inputs every query
starts from, built once and shared.

* the loan panel and the wide/economies tables are lazy plans over the
  driver tables;
* the macro panel is built once and written to the shared checkpoint
  folder (so that the layering join knows its size in bytes);
* the layered panel (loan panel + macro panel) is written once as the
  feature table, so every query scans Parquet (with pushdown and column
  pruning) instead of re-running the joins, and lineage stays short.
"""

from __future__ import annotations

import threading
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.layering import layer_macro
from riskweave.session import checkpoint_dir, scratch_path
from riskweave.sources import fixtures
from riskweave.sources.macro import build_country_mapping, build_macro_panel
from riskweave.sources.versions import read_table, replace_table

# Partition column of the written feature table.
FEATURE_PARTITIONS = ("year",)

_LOCK = threading.Lock()
_CACHE: dict[tuple[int, str], "Workspace"] = {}


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        checkpoint_dir(spark)
        self.models: dict = {}
        self.locks: dict = {}

    def table(self, name: str) -> DataFrame:
        return fixtures.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def loans(self) -> DataFrame:
        return fixtures.loan_panel(self.spark, self.sf_dir)

    @cached_property
    def loan_csv(self) -> DataFrame:
        return fixtures.loan_csv(self.spark, self.sf_dir)

    @cached_property
    def loan_csv_path(self) -> str:
        """The raw loan text written once as a header CSV: the uploaded file."""
        path = scratch_path(self.spark, "loan_csv")
        self.loan_csv.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)
        return path

    @cached_property
    def uneven_csv_path(self) -> str:
        """An upload with records of too many and too few cells."""
        path = scratch_path(self.spark, "uneven_csv")
        fixtures.uneven_lines(self.spark, self.sf_dir).write.text(path)
        return path

    @cached_property
    def economies(self) -> DataFrame:
        return fixtures.economies(self.spark, self.sf_dir)

    @cached_property
    def macro_wide(self) -> DataFrame:
        return fixtures.macro_wide(self.spark, self.sf_dir)

    @cached_property
    def country_mapping(self) -> DataFrame:
        return build_country_mapping(self.economies)

    @cached_property
    def macro_path(self) -> str:
        path = scratch_path(self.spark, "macro_gdp")
        build_macro_panel(self.macro_wide, self.economies).write.parquet(path)
        return path

    @cached_property
    def macro(self) -> DataFrame:
        return self.spark.read.parquet(self.macro_path)

    def layered_plan(self) -> DataFrame:
        """The layering join as a lazy plan (loan panel + macro panel)."""
        return layer_macro(self.loans, self.macro)

    @cached_property
    def feature_table(self) -> tuple[str, list[str]]:
        """The layered panel written once to the shared folder (the feature
        table every dashboard, feature and model query starts from),
        partitioned by ``year`` so year filters prune whole directories."""
        plan = self.layered_plan()
        path = replace_table(plan, scratch_path(self.spark, "ml_features"), partition_by=FEATURE_PARTITIONS)
        return path, plan.columns

    def layered(self) -> DataFrame:
        path, columns = self.feature_table
        df = read_table(self.spark, path)
        return df.select(*[F.col(c).cast("int").alias(c) if c in FEATURE_PARTITIONS else F.col(c)
                           for c in columns])

    @cached_property
    def prepared(self):
        """(fitted prep, prepared train, prepared test, passthrough) of the layered panel."""
        from riskweave.operators.models import prepare
        return prepare(self.layered())

    def model(self, name: str, **params):
        """One fitted model per (name, parameters), shared by the model queries."""
        from riskweave.operators.models import train_and_evaluate
        key = (name, tuple(sorted(params.items())))
        with _LOCK:
            lock = self.locks.setdefault(key, threading.Lock())
        with lock:  # one training per model; others go on
            if key not in self.models:
                self.models[key] = train_and_evaluate(self.layered(), name, prepared=self.prepared, **params)
            return self.models[key]


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (id(spark), sf_dir.rstrip("/"))
    with _LOCK:
        ws = _CACHE.get(key)
        if ws is None or ws.spark is not spark:
            ws = Workspace(spark, sf_dir)
            _CACHE[key] = ws
        return ws
