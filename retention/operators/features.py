"""Cleaning and feature engineering.

All derivations are Column expressions inside one projection (whole-stage
codegen, no Python). Fitted statistics (the MonthlyCharges median, per-column
medians for imputation) are computed by one aggregate and returned as plain
Python values, the way Spark ML estimators keep their fitted state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from .quantile import exact_quantiles


def clean(df: DataFrame) -> DataFrame:
    """Read-boundary cleaning: TotalCharges text -> double (bad/blank -> 0, T1);
    NaN -> NULL in the double inputs (T9); absent TotalCharges -> 0 (P1)."""
    out = df
    if "TotalCharges" in df.columns:
        out = out.withColumn("TotalCharges", C.to_number_or_zero("TotalCharges"))
    else:
        out = out.withColumn("TotalCharges", F.lit(0.0))
    if "MonthlyCharges" in df.columns:
        out = out.withColumn("MonthlyCharges", C.nan_to_null(F.col("MonthlyCharges").cast("double")))
    return out


def exact_median(df: DataFrame, col: str) -> DataFrame:
    """Exact (linearly interpolated) median as a 1-row DataFrame ``median``."""
    return exact_quantiles(df, C.nan_to_null(F.col(col).cast("double")), [0.5]).select(F.col("q0").alias("median"))


def fit_median(df: DataFrame, col: str = "MonthlyCharges") -> float | None:
    row = exact_median(df, col).first()
    return None if row is None else row["median"]


def median_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long table (column, value): exact median of each numeric column (A2).

    One unpivot for all columns; columns without any value have no row."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), C.inf_to_null(F.col(c).cast("double")).alias("v"))
        for c in columns])).alias("s")).select("s.column", "s.v")
    return exact_quantiles(stacked, F.col("v"), [0.5], ["column"]).select("column", F.col("q0").alias("value"))


def engineer(df: DataFrame, median: float | Column | None, mode: str = "score") -> DataFrame:
    """Add the 9 engineered columns. Each is derived only if its inputs exist, else 0."""
    cols = set(df.columns)
    med = median if isinstance(median, Column) else F.lit(median).cast("double")
    out = {}
    if "tenure" in cols:
        out["tenure_bucket"] = C.tenure_bucket("tenure", mode)
    out["services_count"] = C.services_count(K.SERVICE_COLUMNS, present=list(cols))
    out["monthly_to_total_ratio"] = (C.charge_ratio() if {"TotalCharges", "tenure", "MonthlyCharges"} <= cols
                                     else F.lit(0.0))
    out["internet_no_tech_support"] = (C.flag_internet_no_tech_support()
                                       if {"InternetService", "TechSupport"} <= cols else F.lit(0))
    out["phone_no_security"] = (C.flag_phone_no_security()
                                if {"PhoneService", "OnlineSecurity"} <= cols else F.lit(0))
    out["premium_no_backup"] = (C.flag_premium_no_backup(med)
                                if {"MonthlyCharges", "OnlineBackup"} <= cols else F.lit(0))
    out["long_tenure_low_value"] = (C.flag_long_tenure_low_value(med)
                                    if {"tenure", "MonthlyCharges"} <= cols else F.lit(0))
    out["expected_tenure"] = F.lit(K.EXPECTED_TENURE)
    out["clv"] = (F.col("MonthlyCharges") * K.EXPECTED_TENURE if "MonthlyCharges" in cols
                  else F.lit(0.0))
    return df.withColumns(out)


def impute(df: DataFrame, medians: dict[str, float], columns: list[str] | None = None) -> DataFrame:
    """NaN/+-inf -> missing -> the fitted median, numeric columns only."""
    cols = [c for c in (columns or list(medians)) if c in df.columns]
    return df.withColumns({c: F.coalesce(C.inf_to_null(F.col(c)).cast("double"),
                                         F.lit(medians.get(c)).cast("double")) for c in cols})
