"""Scoring and per-customer report columns.

``LinearScorer`` is a logistic scorer over the aligned feature columns expressed as
Column arithmetic (stays in whole-stage codegen). It serves two roles:

* the *frozen scorecards* - fixed literal coefficients, so every operator downstream
  of scoring (metrics, ROC, explanations) has an exact SQL oracle;
* the JVM-side form of a fitted Spark ML logistic-regression pipeline
  (``from_spark_lr``), used for coefficient explanations.

Scoring never shuffles: clean -> engineer -> encode -> align -> probability is one
projection chain; fitted state enters as literals.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from . import encode as EN
from . import features as FE

PROB_DIGITS = 9


@dataclass
class LinearScorer:
    name: str
    coef: dict[str, float]
    intercept: float
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def scaled(self, f: str) -> Column:
        x = F.col(f).cast("double")
        if f in self.mean:
            s = self.scale.get(f, 1.0)
            return F.lit(0.0) if not s else (x - F.lit(self.mean[f])) / F.lit(s)
        return x

    def margin(self) -> Column:
        terms = [F.lit(self.coef[f]) * self.scaled(f) for f in K.FEATURES if self.coef.get(f)]
        return reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept)))

    def probability(self) -> Column:
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin())), PROB_DIGITS)

    def contributions(self) -> Column:
        """array<struct<feature, value, coefficient, contribution>> over all features, in feature order.
        ``value`` is the raw feature value, the contribution coefficient x scaled value."""
        return F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                                  F.lit(float(self.coef.get(f, 0.0))).alias("coefficient"),
                                  (F.lit(float(self.coef.get(f, 0.0))) * self.scaled(f)).alias("contribution"))
                         for f in K.FEATURES])


def from_spark_lr(fitted) -> LinearScorer:
    """LinearScorer equal to a fitted logistic pipeline (``models.FittedModel``): the Spark ML
    coefficients and intercept over the pipeline's population z-scores. Apply it to rows
    imputed with ``fitted.medians`` (``features.impute``); scaling is part of the scorer."""
    lr = fitted.pipeline.stages[-1]
    coef = dict(zip(K.FEATURES, (float(c) for c in lr.coefficients.toArray())))
    mean = {f: float(m) for f, (m, s) in fitted.scaling.items()}
    scale = {f: float(s) for f, (m, s) in fitted.scaling.items()}
    return LinearScorer(fitted.name, coef, float(lr.intercept), mean, scale)


# FIXED VALUES of this library (not from the reference): frozen scorecards
# over encoded features, used as deterministic stand-ins for fitted models.
# DENSE has a coefficient for each of the 28 features: (7 * position mod 23 - 11) / 50.
SCORECARDS = {
    "scorecard": LinearScorer("scorecard", {
        "Contract": -1.1, "internet_no_tech_support": 0.9, "tenure": -0.035,
        "MonthlyCharges": 0.006, "SeniorCitizen": 0.3, "PaymentMethod": 0.12}, 0.2),
    "scorecard_b": LinearScorer("scorecard_b", {
        "Contract": -0.8, "InternetService": -0.4, "TechSupport": -0.3,
        "tenure_bucket": 0.1, "services_count": -0.05, "clv": 0.0002}, 0.6),
}
DENSE = LinearScorer("scorecard_dense", {f: (7 * i % 23 - 11) / 50 for i, f in enumerate(K.FEATURES)}, 0.25)


def features_for_scoring(df: DataFrame, median: float | None, encoder: EN.EncoderState,
                         mode: str = "score", null_as: str = "nan") -> DataFrame:
    """Raw (possibly partial) customer rows -> aligned encoded features.
    Missing median state falls back to the batch's own median (S5)."""
    cleaned = FE.clean(df)
    if median is None and "MonthlyCharges" in cleaned.columns:
        median = FE.fit_median(cleaned, "MonthlyCharges")
    feats = FE.engineer(cleaned, median, mode)
    enc = EN.encode(feats, encoder, null_as=null_as)
    return enc


def customer_id(df: DataFrame, row_col: str | None = None) -> Column:
    """customerID, else customer_id, else customer_<row> (batch) / 'unknown' (P15)."""
    cands = [F.col(c).cast("string") for c in ("customerID", "customer_id") if c in df.columns]
    if row_col and row_col in df.columns:
        cands.append(F.concat(F.lit("customer_"), F.col(row_col).cast("string")))
    cands.append(F.lit("unknown"))
    return F.coalesce(*cands)


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """0-based position of each row in the input (P15 batch ids), JVM-side: the
    monotonically increasing id carries the partition index in its upper bits; rows per
    partition are counted (one row per partition), prefix-summed and broadcast back. The
    result is deterministic for a given input partitioning, so a recomputed task gets the
    same ids."""
    if name in df.columns:
        return df
    from pyspark.sql import Window
    d = df.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.shiftright("_mid", 33))
    counts = d.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))        # one row per input partition
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    return (d.join(F.broadcast(offsets), "_pid")                          # bounded by the partition count
            .withColumn(name, F.col("_off") + F.col("_mid") - F.shiftleft(F.col("_pid"), 33))
            .drop("_mid", "_pid", "_off"))


def score(df: DataFrame, scorer: LinearScorer, keep: list[str] | None = None,
          row_col: str | None = None, medians: dict[str, float] | None = None) -> DataFrame:
    """6-field scoring result per row (M11); empty input -> empty output. With ``medians`` missing numeric
    features take the fitted median first (P16), so every row gets a probability; without them a missing
    input gives a missing probability."""
    if medians:
        df = FE.impute(df, medians, [f for f in K.NUMERIC_FEATURES if f in medians])
    aligned = EN.align_features(df, K.FEATURES, keep=[c for c in df.columns if c not in K.FEATURES])
    p = scorer.probability()
    out = aligned.select(*(keep or []), customer_id(aligned, row_col).alias("customer_id"),
                         F.lit(scorer.name).alias("model_used"), p.alias("churn_probability"))
    return out.select(*(keep or []), "customer_id", "model_used",
                      (F.col("churn_probability") > K.DECISION_THRESHOLD).cast("int").alias("churn_prediction"),
                      "churn_probability",
                      (F.lit(1.0) - F.col("churn_probability")).alias("no_churn_probability"),
                      C.prediction_label().alias("prediction_label"))


def missing_required(df: DataFrame, required=("tenure", "MonthlyCharges")) -> list[str]:
    return [c for c in required if c not in df.columns]


def reject_incomplete(df: DataFrame, required=("tenure", "MonthlyCharges")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a batch without a required column is rejected as a whole;
    otherwise rows with a NULL required value go to the reject output (P14)."""
    miss = missing_required(df, required)
    if miss:
        raise ValueError(f"missing required fields: {miss}")
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required])
    return df.where(~bad), df.where(bad).withColumn(
        "reason", F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]))


def tiers(scored: DataFrame, clv_col: str = "clv") -> DataFrame:
    """Risk label, confidence, gauge band, value priority, action tier."""
    p = F.col("churn_probability")
    return scored.select(
        "customer_id", "model_used", "churn_probability",
        F.when(F.col("churn_prediction") == 1, F.lit("High Risk"))
        .when(F.col("churn_prediction") == 0, F.lit("Low Risk")).alias("risk_label"),
        C.confidence(p).alias("confidence"), C.gauge_band(p).alias("gauge_band"),
        (p * 100 >= K.GAUGE_ALERT_LINE).alias("above_alert_line"),
        C.value_priority(clv_col).alias("value_priority"), C.action_tier(p).alias("action_tier"))


def actions_table(spark) -> DataFrame:
    rows = [(t, i + 1, K.ACTION_HEADLINES[t], a) for t, acts in K.ACTIONS.items() for i, a in enumerate(acts)]
    return spark.createDataFrame(rows, "action_tier string, pos int, headline string, action string")


def recommended_actions(tiered: DataFrame) -> DataFrame:
    """Each customer's 5 actions: join with the fixed 15-row action table (broadcast)."""
    acts = actions_table(tiered.sparkSession)
    return tiered.select("customer_id", "action_tier").join(F.broadcast(acts), "action_tier")


def risk_factors(df: DataFrame) -> DataFrame:
    """Rule-based risk factors per customer, or the default line when none holds."""
    t = K.RISK_FACTOR_TEXTS
    rules = [
        C.eq_safe("Contract", "Month-to-month"),
        C.eq_safe("InternetService", "Fiber optic") & C.eq_safe("TechSupport", "No"),
        C.eq_safe("PaymentMethod", "Electronic check"),
        F.coalesce(F.col("tenure") < K.RISK_NEW_CUSTOMER_MONTHS, F.lit(False)),
        F.coalesce(F.col("MonthlyCharges") > K.RISK_HIGH_CHARGES, F.lit(False)),
        C.eq_safe("OnlineSecurity", "No") & C.eq_safe("OnlineBackup", "No"),
    ]
    arr = F.array_compact(F.array(*[F.when(r, F.struct(F.lit(i + 1).alias("pos"), F.lit(t[i]).alias("factor")))
                                    for i, r in enumerate(rules)]))
    arr = F.when(F.size(arr) == 0, F.array(F.struct(F.lit(0).alias("pos"),
                                                    F.lit(K.RISK_FACTOR_DEFAULT).alias("factor")))).otherwise(arr)
    return df.select(customer_id(df).alias("customer_id"), F.explode(arr).alias("r")).select(
        "customer_id", "r.pos", "r.factor")


def risk_factor_counts(factors: DataFrame) -> DataFrame:
    return factors.groupBy("pos", "factor").agg(F.count(F.lit(1)).alias("customers"))


def domain_violations(df: DataFrame) -> DataFrame:
    """(customer_id, column, value): inputs outside the form's allowed categories / ranges."""
    checks = []
    for c, allowed in K.CATEGORY_DOMAINS.items():
        if c in df.columns:
            checks.append(F.when(~F.coalesce(F.col(c).isin(*allowed), F.lit(False)),
                                 F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))))
    for c, (lo, hi) in K.NUMERIC_DOMAINS.items():
        if c in df.columns:
            v = F.col(c)
            checks.append(F.when(v.isNull() | (v < lo) | (v > hi),
                                 F.struct(F.lit(c).alias("column"), v.cast("string").alias("value"))))
    return df.select(customer_id(df).alias("customer_id"),
                     F.explode(F.array_compact(F.array(*checks))).alias("v")).select("customer_id", "v.column",
                                                                                     "v.value")


def apply_form_defaults(df: DataFrame) -> DataFrame:
    """Fill the fields the manual form does not ask for; TotalCharges = tenure x MonthlyCharges
    when not given (P24)."""
    out = {c: (F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)) for c, v in K.FORM_DEFAULTS.items()}
    tc = F.col("tenure").cast("double") * F.col("MonthlyCharges")
    out["TotalCharges"] = F.coalesce(F.col("TotalCharges").cast("double"), tc) if "TotalCharges" in df.columns else tc
    return df.withColumns(out)


def score_summary(scored: DataFrame) -> DataFrame:
    """Batch totals."""
    return scored.groupBy("model_used").agg(F.count(F.lit(1)).alias("customers"),
                                            F.sum("churn_prediction").cast("bigint").alias("predicted_churners"))
