"""Column expressions shared by all operators.

Null / NaN / interval-closure rules of the reference live here, in one place,
so every operator applies them the same way (SURVEY traps T1-T10, T19):

* NULL is the only missing marker inside the library; NaN is mapped to NULL at
  the read boundary (``nan_to_null``) because Spark orders NaN above every number.
* string comparisons that must treat a missing value as "different" use the
  null-safe ``<=>`` (``eq_safe``), never ``=`` / ``!=``.
* every tier, label and band of a missing probability is missing;
* rounding that must match pandas / numpy is half-even (``bround``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def eq_safe(c: Column | str, value) -> Column:
    """Null-safe equality that yields false (not NULL) when ``c`` is missing."""
    c = F.col(c) if isinstance(c, str) else c
    return c.eqNullSafe(F.lit(value))


def nan_to_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def inf_to_null(c: Column | str) -> Column:
    """NaN and +-inf become NULL (the cleaner's first step)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), c)


def to_number_or_zero(c: Column | str) -> Column:
    """Text -> double; unparsable, blank, NaN or missing -> 0.0 (T1, ANSI-safe)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("string").try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(0.0)).otherwise(d)


def tenure_bucket(tenure: Column | str = "tenure", mode: str = "score") -> Column:
    """Tenure bucket label; intervals are closed on the right.

    mode ``train``: (0,6] (6,12] (12,24] (24,72]; 0 and >72 are NULL
    mode ``score``: as train but the first interval includes 0
    mode ``open``:  (-inf,6] (6,12] (12,24] (24,inf)
    """
    t = F.col(tenure) if isinstance(tenure, str) else tenure
    e0, e1, e2, e3, e4 = K.TENURE_EDGES
    l0, l1, l2, l3 = K.TENURE_LABELS
    if mode == "train":
        first = (t > e0) & (t <= e1)
        last = (t > e3) & (t <= e4)
    elif mode == "score":
        first = (t >= e0) & (t <= e1)
        last = (t > e3) & (t <= e4)
    elif mode == "open":
        first = t <= e1
        last = t > e3
    else:
        raise ValueError(f"unknown tenure bucket mode {mode!r}")
    return (F.when(first, F.lit(l0))
            .when((t > e1) & (t <= e2), F.lit(l1))
            .when((t > e2) & (t <= e3), F.lit(l2))
            .when(last, F.lit(l3)))


def services_count(columns: list[str], present: list[str] | None = None) -> Column:
    """Number of service columns equal to 'Yes'; absent columns are skipped, none -> 0."""
    use = [c for c in K.SERVICE_COLUMNS if present is None or c in present]
    if not use:
        return F.lit(0)
    return reduce(lambda a, b: a + b, [eq_safe(c, "Yes").cast("int") for c in use])


def charge_ratio(total="TotalCharges", tenure="tenure", monthly="MonthlyCharges") -> Column:
    """TotalCharges / max(1, tenure * MonthlyCharges); a missing product stays missing."""
    prod = F.col(tenure).cast("double") * F.col(monthly)
    return F.col(total) / F.when(prod.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(1.0), prod))


def flag_internet_no_tech_support() -> Column:
    return (~eq_safe("InternetService", "No") & eq_safe("TechSupport", "No")).cast("int")


def flag_phone_no_security() -> Column:
    return (eq_safe("PhoneService", "Yes") & eq_safe("OnlineSecurity", "No")).cast("int")


def flag_premium_no_backup(median: Column) -> Column:
    return (F.coalesce(F.col("MonthlyCharges") > median, F.lit(False))
            & eq_safe("OnlineBackup", "No")).cast("int")


def flag_long_tenure_low_value(median: Column) -> Column:
    return (F.coalesce(F.col("tenure") > 24, F.lit(False))
            & F.coalesce(F.col("MonthlyCharges") < median, F.lit(False))).cast("int")


def churn_label(c: Column | str = K.TARGET) -> Column:
    """'Yes' or numeric 1 (of any type, '1' and 1.0 too) -> 1, everything else -> 0."""
    c = (F.col(c) if isinstance(c, str) else c).cast("string")
    return (eq_safe(c, "Yes") | eq_safe(c.try_cast("double"), 1.0)).cast("int")


def prediction_label(p: Column | str = "churn_probability") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > K.DECISION_THRESHOLD, F.lit("Churn")).when(p.isNotNull(), F.lit("No Churn"))


def confidence(p: Column | str = "churn_probability") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when((p > K.CONFIDENCE_HIGH_ABOVE) | (p < K.CONFIDENCE_HIGH_BELOW), F.lit("High"))
            .when(p.isNotNull(), F.lit("Medium")))


def gauge_band(p: Column | str = "churn_probability") -> Column:
    """Band of 100*p: [0,33) low, [33,66) medium, [66,100] high (lower edge inclusive)."""
    p = F.col(p) if isinstance(p, str) else p
    s = p * 100
    _, b1, b2, _ = K.GAUGE_BANDS
    return F.when(s < b1, F.lit("low")).when(s < b2, F.lit("medium")).when(p.isNotNull(), F.lit("high"))


def value_priority(clv: Column | str = "clv") -> Column:
    c = F.col(clv) if isinstance(clv, str) else clv
    return (F.when(c > K.VALUE_PRIORITY_HIGH, F.lit("HIGH"))
            .when(c > K.VALUE_PRIORITY_MEDIUM, F.lit("MEDIUM")).otherwise(F.lit("STANDARD")))


def action_tier(p: Column | str = "churn_probability") -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return (F.when(p > K.ACTION_URGENT_ABOVE, F.lit("URGENT"))
            .when(p > K.ACTION_MODERATE_ABOVE, F.lit("MODERATE")).when(p.isNotNull(), F.lit("LOW")))


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    """Deterministic per-row choice key: md5 of key + '/' + seed (same hex in DuckDB)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"/{seed}")))
