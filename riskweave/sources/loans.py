"""Loan-panel source: CSV/Parquet ingest with lenient typing, contract
check and session/country tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.dates import parse_date
from riskweave.functions.nulls import na_token_to_null, nan_to_null, number, to_double, to_long
from riskweave.schema import CONTRACT_COLUMNS, DATE_COLUMNS, LOAN_TYPES
from riskweave.sources.csv_records import read_csv
from riskweave.sources.versions import read_table

# Standard quoting: a quote inside a quoted cell is doubled, and a quoted
# cell may hold line breaks. Spark's own reader does not split such files;
# loan panels are read by riskweave.sources.csv_records, which does.
CSV_STANDARD = {"quote": '"', "escape": '"', "multiLine": True}

_CASTS = {
    T.LongType: to_long,
    T.DoubleType: to_double,
}


def validate_loans(df: DataFrame) -> list[str]:
    """Contract columns missing from ``df`` (schema only, no job)."""
    return [c for c in CONTRACT_COLUMNS if c not in df.columns]


def type_loans(raw: DataFrame, extra_types: dict[str, str] | None = None,
               infer_extras: bool = True) -> DataFrame:
    """All-text loan frame -> typed panel.

    Missing-value tokens become NULL first, then every contract column is
    converted with a non-raising cast (bad cells -> NULL, never a failed
    job), dates through the lenient parser. ``year`` is derived from
    ``loan_date``. Extra columns are typed by ``extra_types`` or, with
    ``infer_extras`` (the default, as the original reader infers every
    column), by one aggregate over all extra columns together.
    """
    cleaned = raw.select(*[na_token_to_null(c).alias(c) for c in raw.columns])
    extras = [c for c in cleaned.columns if c not in LOAN_TYPES]
    types = dict(extra_types or {})
    if infer_extras and extras:
        types.update(_infer_numeric(cleaned, [c for c in extras if c not in types]))
    whole = [c for c in cleaned.columns if isinstance(LOAN_TYPES.get(c), T.LongType)]
    fractions = {c for c, t in _infer_numeric(cleaned, whole, text_allowed=True).items() if t == "double"}
    cols = []
    for c in cleaned.columns:
        if c in DATE_COLUMNS:
            cols.append(parse_date(c).alias(c))
        elif c in LOAN_TYPES:
            # A whole-number column with a fraction in some cell keeps it, as a double.
            dt = T.DoubleType() if c in fractions else LOAN_TYPES[c]
            fn = _CASTS.get(type(dt))
            cols.append((fn(c) if fn else F.col(c).cast(dt)).alias(c))
        elif c in types:
            t = types[c]
            if t == "boolean":
                cols.append(F.lower(F.trim(c)).isin("true").alias(c))
            else:
                cols.append((to_long(c) if t == "bigint" else to_double(c) if t == "double"
                             else F.col(c).try_cast(t)).alias(c))
        else:
            cols.append(F.col(c))
    typed = cleaned.select(*cols)
    if "loan_date" in typed.columns:
        typed = typed.withColumn("year", F.year("loan_date").cast("int"))
    return typed


# FIXED VALUES: cells the original CSV reader reads as booleans.
BOOL_TOKENS = ("True", "TRUE", "true", "False", "FALSE", "false")


def _infer_numeric(df: DataFrame, cols: list[str], text_allowed: bool = False) -> dict[str, str]:
    """One aggregate over all columns: a text column whose non-null cells all
    parse as numbers becomes bigint (all integral) or double; one whose
    cells are all boolean words, with none missing, becomes boolean (a
    missing cell keeps it text, as in the original reader). With
    ``text_allowed`` other cells do not stop a column from being a number."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        d = number(c)
        aggs.append(F.count_if(F.col(c).isNotNull() & d.isNull()).alias(f"{c}__bad"))
        aggs.append(F.count_if(d.isNotNull() & (d != F.floor(d))).alias(f"{c}__frac"))
        aggs.append(F.count(d).alias(f"{c}__n"))
        aggs.append(F.count_if(F.trim(c).isin(*BOOL_TOKENS)).alias(f"{c}__bool"))
    aggs.append(F.count(F.lit(1)).alias("__rows"))
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        if row[f"{c}__n"] and (text_allowed or row[f"{c}__bad"] == 0):
            out[c] = "double" if row[f"{c}__frac"] else "bigint"
        elif row["__rows"] and row[f"{c}__bool"] == row["__rows"]:
            out[c] = "boolean"
    return out


def conform_loans(df: DataFrame) -> DataFrame:
    """A typed loan frame (e.g. from Parquet) brought to the contract types:
    contract columns of another type are converted without raising, float
    NaN becomes NULL, and ``year`` is derived from ``loan_date`` when absent.
    Extra columns keep their stored types."""
    cols = []
    for f in df.schema.fields:
        want = LOAN_TYPES.get(f.name)
        if want is None or f.dataType == want:
            cols.append(nan_to_null(f.name).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                        else F.col(f.name))
        elif isinstance(want, T.DateType):
            cols.append((parse_date(f.name) if isinstance(f.dataType, T.StringType)
                         else F.col(f.name).try_cast("date")).alias(f.name))
        elif isinstance(want, T.DoubleType):
            cols.append(to_double(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name).try_cast(want).alias(f.name))
    out = df.select(*cols)
    if "loan_date" in out.columns and "year" not in out.columns:
        out = out.withColumn("year", F.year("loan_date").cast("int"))
    return out


def loan_template(spark: SparkSession) -> DataFrame:
    """The upload template: the contract columns as text, without rows."""
    return spark.createDataFrame([], ", ".join(f"{c} string" for c in CONTRACT_COLUMNS))


def unparsed_dates(raw: DataFrame) -> DataFrame:
    """(variable, unparsed): per date column of an all-text loan frame the
    cells that hold something which is neither a missing-value token nor a
    date in a known layout."""
    cols = [c for c in DATE_COLUMNS if c in raw.columns]
    if not cols:
        return raw.sparkSession.createDataFrame([], "variable string, unparsed bigint")
    cells = {c: na_token_to_null(c) for c in cols}
    counts = raw.agg(*[F.count_if(x.isNotNull() & (F.trim(x) != "") & parse_date(x).isNull()).alias(c) for c, x in cells.items()])
    stack = ", ".join(f"'{c}', {c}" for c in cols)
    return counts.selectExpr(f"stack({len(cols)}, {stack}) AS (variable, unparsed)")


def read_loans(spark: SparkSession, path: str, fmt: str = "csv", **kwargs) -> DataFrame:
    """Read an uploaded loan panel.

    CSV is read as text in byte ranges (also a single large file) and typed
    by :func:`type_loans`; other formats are brought to the contract types
    by :func:`conform_loans`. Records with too many cells are left out, see
    :func:`rejected_records`.
    """
    if fmt == "csv":
        panel, _ = read_csv(spark, path)
        return type_loans(panel, **kwargs)
    return conform_loans(read_table(spark, path, fmt))


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, cells, error, record): the records of uploaded CSV files
    with more or fewer cells than the header; those with fewer are in the
    panel all the same, the missing cells null."""
    return read_csv(spark, path)[1]


def tag_loans(df: DataFrame, session_id: str, country_code: str | None = None) -> DataFrame:
    """Constant tags: the session id, and the portfolio's country code when given."""
    out = df.withColumn("session_id", F.lit(session_id))
    if country_code is not None:
        out = out.withColumn("country_code", F.lit(country_code))
    return out
