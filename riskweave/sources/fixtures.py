"""Loan and macro inputs derived from the driver tables (FIXTURES.md).

The original application ships no data, so the loan panel, the wide
indicator table and the economies table are derived deterministically
from the TPC-H style tables: lazy DataFrame code but for the years of ``macro_wide``.

Scale notes:
* ``loan_panel`` joins orders with customer on the customer key (a
  shuffle join at scale, AQE splits a hot customer); dimension tables
  (nation, region) are left to the optimizer's size-based broadcast
  choice, which reads file statistics and runs no job.
* ``macro_wide`` pre-aggregates lineitem to (supplier, ship year) before
  any join, so the joins see suppliers x years rows, and derives the
  regional rows from the national totals instead of scanning lineitem a
  second time. Decimal sums keep the result independent of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# FIXED VALUES of the derived fixtures (FIXTURES.md): null rules, segment
# mapping, tenure by priority, default signal, and the omitted macro cell.
NULL_TYPE_MOD, NULL_DATE_MOD, NULL_AMOUNT_MOD, NULL_FLAG_MOD = 97, 101, 89, 103
PADDED_CODE_MOD = 5
RETAIL_SEGMENTS = ("HOUSEHOLD", "FURNITURE")
SME_SEGMENTS = ("BUILDING", "AUTOMOBILE")
TENURE_BY_PRIORITY = (("1", 30), ("2", 90), ("3", 180), ("4", 365))
TENURE_OTHER = 730
HIGH_RISK_PRIORITIES = ("4", "5")
HIGH_RISK_PRICE = 300000
FLAG_MOD = 11
PAYOFF_SHIFT_MOD = 20
MISSING_CELL = ("NATION_7", 1997)
CSV_JUNK_MOD, CSV_JUNK_REM = 50, 7
# Hard cells of the raw CSV: a quoted cell with delimiter, quotes and a line break, a fraction of days, an
# amount in scientific form; records with a cell too many and with three cells only.
CSV_QUOTED_MOD, CSV_QUOTED_REM, CSV_QUOTED = 83, 4, 'SME, "old"\nbook'
CSV_FRACTION_MOD, CSV_FRACTION_REM = 59, 3
CSV_LARGE_MOD, CSV_LARGE_REM, CSV_LARGE = 61, 5, "1e17"
CSV_LONG_MOD, CSV_LONG_REM, CSV_SHORT_MOD, CSV_SHORT_REM = 97, 5, 89, 3


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def loan_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    base = (orders
            .join(customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey")))

    key = F.col("o_orderkey")
    prio = F.substring("o_orderpriority", 1, 1)
    tenure = F.lit(TENURE_OTHER)
    for p, days in reversed(TENURE_BY_PRIORITY):
        tenure = F.when(prio == p, F.lit(days)).otherwise(tenure)
    seg = F.col("c_mktsegment")
    borrower_type = (F.when(key % NULL_TYPE_MOD == 0, F.lit(None).cast("string"))
                     .when(seg.isin(*RETAIL_SEGMENTS), "Retail")
                     .when(seg.isin(*SME_SEGMENTS), "SME")
                     .otherwise("Corporate"))
    loan_date = F.when(key % NULL_DATE_MOD == 0, F.lit(None).cast("date")) \
        .otherwise(F.col("o_orderdate").cast("date"))
    default_flag = (F.when(key % NULL_FLAG_MOD == 0, F.lit(None))
                    .when(prio.isin(*HIGH_RISK_PRIORITIES) & (F.col("o_totalprice") > HIGH_RISK_PRICE), 1)
                    .when(key % FLAG_MOD == 0, 1)
                    .otherwise(0)).cast("double")
    country = F.when(F.col("o_custkey") % PADDED_CODE_MOD == 0, F.concat(F.col("n_name"), F.lit(" "))) \
        .otherwise(F.col("n_name"))

    b = base.select(
        key.alias("loan_no"),
        F.col("o_custkey").alias("borrower_id"),
        borrower_type.alias("borrower_type"),
        loan_date.alias("loan_date"),
        tenure.cast("int").alias("tenure_i"),
        F.when(key % NULL_AMOUNT_MOD == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_totalprice")).alias("amount"),
        default_flag.alias("default_flag"),
        country.alias("country_code"),
        F.col("o_orderstatus").alias("status"),
    )
    return b.select(
        "loan_no", "borrower_id", "borrower_type", "loan_date",
        F.date_add("loan_date", F.col("tenure_i")).alias("due_date"),
        F.when(F.col("status") == "F",
               F.date_add("loan_date", F.col("tenure_i") - (F.col("loan_no") % PAYOFF_SHIFT_MOD).cast("int")))
         .alias("payoff_date"),
        F.col("tenure_i").cast("bigint").alias("tenure_days"),
        "amount", "default_flag", "country_code",
        F.year("loan_date").cast("int").alias("year"),
    )


def loan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loan panel as raw CSV text, all contract columns: mixed date
    layouts, null tokens, junk, quoted cells, fractions, large numbers."""
    p = loan_panel(spark, sf_dir)
    s = F.col("loan_date").cast("string")
    no = F.col("loan_no")
    date_txt = (F.when(F.col("loan_date").isNull(), F.lit("n/a"))
                .when(no % CSV_JUNK_MOD == CSV_JUNK_REM, F.lit("junk"))
                .when(no % 3 == 0, s)
                .when(no % 3 == 1, F.concat_ws("/", F.substring(s, 9, 2), F.substring(s, 6, 2), F.substring(s, 1, 4)))
                .otherwise(F.concat_ws("-", F.substring(s, 9, 2), F.substring(s, 6, 2), F.substring(s, 1, 4))))
    return p.select(
        no.cast("string").alias("loan_no"),
        F.col("borrower_id").cast("string").alias("borrower_id"),
        F.when(no % CSV_QUOTED_MOD == CSV_QUOTED_REM, F.lit(CSV_QUOTED)).otherwise(F.coalesce("borrower_type", F.lit("NA"))).alias("borrower_type"),
        date_txt.alias("loan_date"),
        F.coalesce(F.date_format("due_date", "yyyy/MM/dd"), F.lit("null")).alias("due_date"),
        F.coalesce(F.date_format("payoff_date", "dd/MM/yyyy"), F.lit("")).alias("payoff_date"),
        F.concat(F.col("tenure_days").cast("string"), F.when(no % CSV_FRACTION_MOD == CSV_FRACTION_REM, ".5").otherwise("")).alias("tenure_days"),
        F.when(no % CSV_LARGE_MOD == CSV_LARGE_REM, CSV_LARGE).otherwise(F.coalesce(F.col("amount").cast(T.DecimalType(18, 2)).cast("string"), F.lit(""))).alias("amount"),
        F.coalesce(F.col("default_flag").cast("int").cast("string"), F.lit("NA")).alias("default_flag"),
    )


def uneven_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw CSV as lines (value), a header line in each partition, some
    records with a cell too many and some with three cells only."""
    raw = loan_csv(spark, sf_dir)
    no = F.col("loan_no").cast("bigint")
    text = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) if c == "borrower_type" else F.col(c) for c in raw.columns]
    line = (F.when(no % CSV_LONG_MOD == CSV_LONG_REM, F.concat_ws(",", *text, F.lit("extra")))
            .when(no % CSV_SHORT_MOD == CSV_SHORT_REM, F.concat_ws(",", *text[:3])).otherwise(F.concat_ws(",", *text)))
    header = ",".join(raw.columns)

    def with_header(batches):
        import pyarrow as pa
        first = True
        for b in batches:
            if first and b.num_rows:
                first = False
                yield pa.RecordBatch.from_arrays([pa.array([header], b.schema.field(0).type)], schema=b.schema)
            yield b

    return raw.select(line.alias("value")).mapInArrow(with_header, "value string")


def economies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (nation.select(F.col("n_name").alias("id"),
                          F.concat(F.lit("Country "), F.col("n_nationkey").cast("string")).alias("name"),
                          F.lit(False).alias("aggregate"))
            .unionByName(region.select(F.col("r_name").alias("id"),
                                       F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("name"),
                                       F.lit(True).alias("aggregate"))))


def macro_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier revenue by economy (nation or region) and ship year, wide;
    one column per ship year that occurs (one small job finds them)."""
    lineitem = read_table(spark, sf_dir, "lineitem")
    years = sorted(r[0] for r in lineitem.select(F.year("l_shipdate")).distinct().collect() if r[0] is not None)
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # Map-side combined to one row per (supplier, year) before the joins.
    per_supplier = (lineitem
                    .select("l_suppkey", F.year("l_shipdate").alias("y"),
                            F.col("l_extendedprice").cast(T.DecimalType(18, 2)).alias("p"))
                    .groupBy("l_suppkey", "y").agg(F.sum("p").alias("p")))
    per_nation = (per_supplier
                  .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
                  .groupBy("n_nationkey", "n_name", "n_regionkey", "y")
                  .agg(F.sum("p").alias("p")))
    nation_rows = per_nation.select(
        F.col("n_name").alias("economy"),
        F.concat(F.lit("Country "), F.col("n_nationkey").cast("string")).alias("country"),
        "y", "p")
    region_rows = (per_nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
                   .select(F.col("r_name").alias("economy"),
                           F.concat(F.lit("Region "), F.col("r_regionkey").cast("string")).alias("country"),
                           "y", "p"))
    skip_economy, skip_year = MISSING_CELL
    cols = []
    for yr in years:
        cond = F.col("y") == yr
        if yr == skip_year:
            cond = cond & (F.col("economy") != skip_economy)
        cols.append(F.sum(F.when(cond, F.col("p"))).cast("double").alias(f"YR{yr}"))
    return nation_rows.unionByName(region_rows).groupBy("economy", "country").agg(*cols)
