"""Schemas, column lists and fixed values of the loan-panel data model.

Everything in the block marked FIXED VALUES must equal what the original
application uses; it is stated plainly here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original application's behaviour)
# ---------------------------------------------------------------------------

# Text cells read as missing by the original CSV reader.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Upload contract: the nine documented loan columns, in template order.
CONTRACT_COLUMNS = (
    "borrower_id", "borrower_type", "loan_no", "loan_date", "due_date",
    "payoff_date", "tenure_days", "amount", "default_flag",
)

# Columns dropped before training (ids and leakage), when present.
LEAKAGE_COLUMNS = (
    "default_flag", "session_id", "borrower_id", "loan_no", "loan_date",
    "payoff_date", "country_code", "due_date",
)

# Columns left out of the summary-statistics table.
SUMMARY_EXCLUDE = ("session_id", "borrower_id", "loan_no", "default_flag", "year")

# Columns left out of the correlation matrix (default_flag stays in).
CORR_EXCLUDE = ("session_id", "borrower_id", "loan_no", "year")

# Standard columns; any other numeric column is treated as a macro variable.
STANDARD_COLUMNS = (
    "borrower_id", "borrower_type", "loan_no", "loan_date", "due_date",
    "payoff_date", "tenure_days", "amount", "default_flag", "session_id",
    "country_code", "year", "year_month",
)

# Macro columns not carried onto loans by the layering join.
MACRO_EXCLUDE = ("country_code", "country_name", "year", "indicator_type")

# Macro panel tags and the frequency value of the annual join branch.
ANNUAL = "Annual"
GDP_INDICATOR = "GDP"

# Prefix of year columns in the wide indicator table ('YR2010' -> '2010').
YEAR_PREFIX = "YR"

# Country mapping used when no mapping table exists.
FALLBACK_COUNTRY_MAPPING = {"Kenya": "KEN", "Database Missing": "ERR"}

# Fill value for missing categories and the month key of a missing date.
MISSING_CATEGORY = "missing"
MISSING_MONTH = "NaT"

# Loss-given-default parameter, percent: default and allowed range/step.
LGD_DEFAULT_PCT = 45
LGD_MIN_PCT, LGD_MAX_PCT, LGD_STEP_PCT = 10, 100, 5

# Train/test split: test share and seed.
TEST_SHARE_PCT = 20
SPLIT_SEED = 42

# Class labels of the default distribution.
CLASS_LABELS = ((0, "Performing"), (1, "Defaulted"))

# Number of grid points of the density estimate and its support in bandwidths.
KDE_GRID_POINTS = 200
KDE_CUT = 3.0

# Number of features shown in the attribution ranking.
TOP_FEATURES = 10

# Accepted date layouts, tried in order (day-first, lenient).
DATE_FORMATS = (
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d", "yyyy/M/d",
    "yyyyMMdd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "M/d/yyyy", "M-d-yyyy",
    "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "MMMM d, yyyy",
    "d/M/yy", "M/d/yy", "yyyy-d-M", "yyyy/d/M",
    "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss",
    "yyyy-M-d H:mm", "yyyy-M-d'T'H:mm", "d-M-yyyy H:mm", "d-M-yyyy H:mm:ss",
    "d.M.yyyy H:mm", "d.M.yy", "d-M-yy", "MMM yyyy", "MMMM yyyy",
    "MMM d yyyy", "MMMM d yyyy", "d MMM yy", "d-MMM-yy",
)

# ---------------------------------------------------------------------------
# Spark types of the contract columns
# ---------------------------------------------------------------------------

LOAN_TYPES = {
    "borrower_id": T.StringType(),
    "borrower_type": T.StringType(),
    "loan_no": T.StringType(),
    "loan_date": T.DateType(),
    "due_date": T.DateType(),
    "payoff_date": T.DateType(),
    "tenure_days": T.LongType(),
    "amount": T.DoubleType(),
    "default_flag": T.DoubleType(),
}

DATE_COLUMNS = ("loan_date", "due_date", "payoff_date")

MACRO_SCHEMA = T.StructType([
    T.StructField("country_code", T.StringType()),
    T.StructField("country_name", T.StringType()),
    T.StructField("year", T.StringType()),
    T.StructField("gdp_usd", T.DoubleType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("indicator_type", T.StringType()),
])


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_feature_numeric(dt: T.DataType) -> bool:
    """64-bit integers and doubles become numeric model features.

    32-bit ints, booleans and dates are left out, as in the original
    column selection by dtype.
    """
    return isinstance(dt, (T.LongType, T.DoubleType))


def is_feature_categorical(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)
