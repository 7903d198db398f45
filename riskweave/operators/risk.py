"""Credit-risk numbers from a probability of default (PD).

Per loan: LGD is a parameter (percent, 10..100 in steps of 5), EAD is the
loan amount, EL = PD x LGD x EAD (a missing amount gives a missing EL).
For the portfolio: total EAD, total EL and EL / EAD x 100 (0 when EAD is 0).
All of it is projection and one map-side combined aggregate; the totals sum
doubles as given, so registered queries round them to cents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.schema import LGD_DEFAULT_PCT, LGD_MAX_PCT, LGD_MIN_PCT, LGD_STEP_PCT

DISPLAY_COLUMNS = ("borrower_id", "loan_no", "amount", "pd", "lgd", "el")


def lgd_fraction(lgd_pct: int = LGD_DEFAULT_PCT) -> float:
    """Validated LGD parameter, percent -> fraction."""
    if not (LGD_MIN_PCT <= lgd_pct <= LGD_MAX_PCT) or (lgd_pct - LGD_MIN_PCT) % LGD_STEP_PCT:
        raise ValueError(f"LGD must be {LGD_MIN_PCT}..{LGD_MAX_PCT} in steps of {LGD_STEP_PCT}, got {lgd_pct}")
    return lgd_pct / 100.0


def expected_loss(loans: DataFrame, pd: str | Column = "pd", lgd_pct: int = LGD_DEFAULT_PCT,
                  amount: str = "amount") -> DataFrame:
    """Adds pd, lgd, ead and el; returns the display columns that exist plus ead."""
    lgd = lgd_fraction(lgd_pct)
    p = F.col(pd) if isinstance(pd, str) else pd
    out = loans.withColumns({"pd": p.cast("double"), "lgd": F.lit(lgd)})
    if amount in loans.columns:
        out = out.withColumns({"ead": F.col(amount).cast("double")}) \
            .withColumn("el", F.col("pd") * F.col("lgd") * F.col("ead"))
    cols = [c for c in DISPLAY_COLUMNS if c in out.columns]
    if "ead" in out.columns:
        cols.append("ead")
    return out.select(*cols)


def expected_loss_totals(el: DataFrame) -> DataFrame:
    """total_ead, total_el, el_rate (percent) of a frame from :func:`expected_loss`."""
    t = el.agg(F.coalesce(F.sum(F.col("ead").cast("double")), F.lit(0.0)).alias("total_ead"),
               F.coalesce(F.sum(F.col("el").cast("double")), F.lit(0.0)).alias("total_el"))
    return t.withColumn("el_rate", F.when(F.col("total_ead") > 0,
                                          F.col("total_el") / F.col("total_ead") * 100.0).otherwise(F.lit(0.0)))
