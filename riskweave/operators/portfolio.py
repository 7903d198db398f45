"""Portfolio dashboard tables: KPIs, class distribution, filters, distinct
values, preview, monthly series and default rate by category.

Every function is DataFrame in -> DataFrame out and lazy. Aggregates are
plain ``groupBy``/``agg``, so Spark combines map-side before the shuffle
and a hot key costs one partial row per task. Money is summed in doubles as it
is, without rounding amounts first; sums can differ in the last bits with
the order in which partitions are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.dates import year_month
from riskweave.schema import CLASS_LABELS, MISSING_MONTH

ALL = "All"


def money_sum(col: str | Column) -> Column:
    """Sum of a money column; all-NULL input sums to 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def pct(num: Column, den: Column) -> Column:
    """num / den * 100; NULL when den is 0 (ANSI-safe)."""
    return F.try_divide(num.cast("double"), den.cast("double")) * 100.0


def portfolio_kpis(df: DataFrame) -> DataFrame:
    """total_loans (all rows), total_defaults (sum of flags), default_rate (0 when empty)."""
    has_flag = "default_flag" in df.columns
    defaults = (F.coalesce(F.sum("default_flag"), F.lit(0.0)).cast("bigint") if has_flag
                else F.lit(0).cast("bigint"))
    k = df.agg(F.count(F.lit(1)).alias("total_loans"), defaults.alias("total_defaults"))
    return k.select(
        "total_loans", "total_defaults",
        F.when(F.col("total_loans") > 0,
               F.col("total_defaults").cast("double") / F.col("total_loans") * 100.0)
         .otherwise(F.lit(0.0)).alias("default_rate"))


def default_distribution(df: DataFrame) -> DataFrame:
    """Counts of the two classes (a missing class counts 0; NULL flags are not
    counted). No rows without a default_flag column."""
    if "default_flag" not in df.columns:
        return df.sparkSession.createDataFrame([], "class int, label string, value bigint")
    counts = df.agg(*[F.count_if(F.col("default_flag") == cls).alias(f"c{cls}") for cls, _ in CLASS_LABELS])
    stack = ", ".join(f"{cls}, '{label}', c{cls}" for cls, label in CLASS_LABELS)
    return counts.selectExpr(f"stack({len(CLASS_LABELS)}, {stack}) AS (class, label, value)") \
        .select(F.col("class").cast("int").alias("class"), "label", F.col("value").cast("bigint").alias("value"))


def filter_portfolio(df: DataFrame, borrower_type: str = ALL, year: int | str = ALL) -> DataFrame:
    """Equality filters; 'All' leaves the frame unfiltered (pushed to the scan by Catalyst)."""
    out = df
    if borrower_type != ALL and "borrower_type" in df.columns:
        out = out.where(F.col("borrower_type") == borrower_type)
    if year != ALL and "year" in df.columns:
        out = out.where(F.col("year") == int(year))
    return out


def distinct_values(df: DataFrame, col: str, cast: str | None = None) -> DataFrame:
    """Non-null distinct values of ``col`` (the filter choices), ordered."""
    c = F.col(col) if cast is None else F.col(col).cast(cast)
    return df.select(c.alias(col)).where(F.col(col).isNotNull()).distinct().orderBy(col)


def preview(df: DataFrame, n: int = 100, order_by: str = "loan_no") -> DataFrame:
    """First ``n`` rows by ``order_by`` (top-n per partition, then merged)."""
    return df.orderBy(order_by).limit(n)


def monthly_series(df: DataFrame) -> DataFrame:
    """Per 'yyyy-MM' of loan_date ('NaT' for a missing date): loans with an
    amount, total amount, defaults and their rate (NULL with no loans). No
    rows unless loan_date, amount and default_flag are all there."""
    if not {"loan_date", "amount", "default_flag"} <= set(df.columns):
        return df.sparkSession.createDataFrame(
            [], "year_month string, total_loans bigint, total_amount double, defaults double, default_rate double")
    g = df.groupBy(year_month("loan_date", MISSING_MONTH).alias("year_month")).agg(
        F.count("amount").alias("total_loans"),
        money_sum("amount").alias("total_amount"),
        F.coalesce(F.sum("default_flag"), F.lit(0.0)).alias("defaults"))
    return g.withColumn("default_rate", pct(F.col("defaults"), F.col("total_loans"))).orderBy("year_month")


def default_rate_by(df: DataFrame, key: str = "borrower_type") -> DataFrame:
    """Mean default flag x 100 per non-null category (NULL flags excluded). No
    rows unless both columns are there."""
    if not {key, "default_flag"} <= set(df.columns):
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(key, T.StringType()), T.StructField("default_rate", T.DoubleType())]))
    return (df.where(F.col(key).isNotNull()).groupBy(key)
            .agg((F.avg("default_flag") * 100.0).alias("default_rate"))
            .orderBy(key))
