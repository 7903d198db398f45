"""Macro-panel builder, country mapping and their readers.

The wide indicator table (one row per economy, one column per year) is
turned into the long panel: strip the year prefix from column names,
keep sovereign economies only (left semi join with the economies table),
unpivot, tag, drop missing measures. All steps are narrow except the
semi join, whose economies side the optimizer broadcasts by its size
statistics (a few hundred rows) or AQE converts at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.schema import ANNUAL, FALLBACK_COUNTRY_MAPPING, GDP_INDICATOR, MACRO_SCHEMA, YEAR_PREFIX
from riskweave.sources.versions import current

# Renames of the identifier columns of the wide table and the economies table.
WIDE_RENAMES = {"economy": "country_code", "Country": "country_name", "country": "country_name"}
ECONOMY_RENAMES = {"id": "country_code", "name": "country_name"}


def strip_year_prefix(df: DataFrame) -> DataFrame:
    """'YR2010' -> '2010' in every column name (prefix removed anywhere)."""
    return df.toDF(*[c.replace(YEAR_PREFIX, "") for c in df.columns])


def sovereign_ids(economies: DataFrame) -> DataFrame:
    return economies.where(~F.col("aggregate")).select(F.col("id").alias("country_code"))


def build_macro_panel(wide: DataFrame, economies: DataFrame,
                      frequency: str = ANNUAL, indicator: str = GDP_INDICATOR,
                      value_name: str = "gdp_usd") -> DataFrame:
    """Wide indicator table -> long panel (country_code, country_name, year, value, tags)."""
    renamed = strip_year_prefix(wide)
    renamed = renamed.withColumnsRenamed({k: v for k, v in WIDE_RENAMES.items() if k in renamed.columns})
    ids = ["country_code", "country_name"]
    sovereign = renamed.join(sovereign_ids(economies), "country_code", "left_semi")
    year_cols = [c for c in sovereign.columns if c not in ids]
    long = sovereign.unpivot(ids, year_cols, "year", value_name)
    return (long
            .withColumn("frequency", F.lit(frequency))
            .withColumn("indicator_type", F.lit(indicator))
            .na.drop(subset=[value_name]))


def build_country_mapping(economies: DataFrame) -> DataFrame:
    """Sovereign economies as (country_name, country_code)."""
    return (economies.where(~F.col("aggregate"))
            .withColumnsRenamed(ECONOMY_RENAMES)
            .select("country_name", "country_code"))


def country_lookup(spark: SparkSession, mapping: DataFrame | None) -> DataFrame:
    """Name -> code lookup ordered by name; one code per name.

    A duplicated name keeps its greatest code (the original keeps whichever
    came last, an order the source does not define). Without a mapping the
    fixed fallback pairs are returned.
    """
    if mapping is None:
        return spark.createDataFrame(list(FALLBACK_COUNTRY_MAPPING.items()),
                                     "country_name string, country_code string")
    return (mapping.groupBy("country_name").agg(F.max("country_code").alias("country_code"))
            .orderBy("country_name"))


def resolve_country_code(lookup: DataFrame, country_name: str) -> DataFrame:
    """One-row frame holding the code of ``country_name`` (none if unknown)."""
    return lookup.where(F.col("country_name") == country_name).select("country_code")


def read_macro(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a stored macro panel (Parquet, or CSV with the panel schema)."""
    if fmt == "csv":
        return spark.read.schema(MACRO_SCHEMA).option("header", True).csv(path)
    return spark.read.format(fmt).load(current(spark, path))


def read_mapping(spark: SparkSession, path: str | None, fmt: str = "parquet") -> DataFrame | None:
    """Read a stored country mapping; ``None`` when the path does not exist."""
    if path is None:
        return None
    try:
        reader = spark.read.option("header", True) if fmt == "csv" else spark.read
        return reader.format(fmt).load(current(spark, path))
    except Exception as exc:  # missing table -> fallback mapping
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return None
        raise
