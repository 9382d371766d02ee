"""Classification metrics, ROC and model selection.

All metrics for all (model, split) groups come from one grouped aggregate of
conditional counts; no per-model or per-split job. The AUC and ROC need counts
ordered by score: scores are first collapsed to distinct values per group
(partial aggregation), then ordered with the two-level prefix sum on a fixed grid
of 10,001 score buckets (``rank.prefix_sums``), never with a whole-table window.
The AUC numerator is summed in decimals (2 x count products) so it is exact and cannot overflow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import cut_lineage
from .rank import prefix_sums

SCORE_GRID = 10_000


def confusion(scored: DataFrame, groups: list[str], label: str = "label",
              pred: str = "churn_prediction") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return scored.groupBy(*groups).agg(
        F.sum(((y == 0) & (p == 0)).cast("long")).alias("tn"),
        F.sum(((y == 0) & (p == 1)).cast("long")).alias("fp"),
        F.sum(((y == 1) & (p == 0)).cast("long")).alias("fn"),
        F.sum(((y == 1) & (p == 1)).cast("long")).alias("tp"))


def _ratio(num, den):
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def rates(cm: DataFrame, groups: list[str]) -> DataFrame:
    """precision, recall, f1, balanced accuracy; 0 when a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    tpr = _ratio(tp, tp + fn)
    tnr = _ratio(tn, tn + fp)
    return cm.select(*groups, "tn", "fp", "fn", "tp",
                     _ratio(tp, tp + fp).alias("precision"), tpr.alias("recall"),
                     _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     ((tpr + tnr) / 2).alias("balanced_accuracy"))


def score_counts(scored: DataFrame, groups: list[str], label: str = "label",
                 prob: str = "churn_probability") -> DataFrame:
    """Distinct scores per group with positive / negative counts, plus the counts of
    strictly higher scores (``pos_before``, ``neg_before``) and the group totals."""
    # the prefix sum reads it twice: scored rows are read once
    return _with_ranks(cut_lineage(scored.groupBy(*groups, prob).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"))), groups, prob)


def _with_ranks(distinct: DataFrame, groups: list[str], prob: str) -> DataFrame:
    # descending score order == ascending bucket of (grid - floor(score * grid))
    bucket = (F.lit(SCORE_GRID) - F.floor(F.col(prob) * SCORE_GRID)).cast("int")
    return prefix_sums(distinct, groups, bucket, [F.col(prob).desc()], ["pos", "neg"])


def auc(scored: DataFrame, groups: list[str], label: str = "label", prob: str = "churn_probability") -> DataFrame:
    """ROC AUC with tied scores counted half (A15) - equal to the rank-sum statistic."""
    return _auc_of(score_counts(scored, groups, label, prob), groups)


def _auc_of(sc: DataFrame, groups: list[str]) -> DataFrame:
    # decimals: the counts' products pass a bigint from about 2e9 rows of each class
    num2 = F.sum(F.col("neg").cast("decimal(18,0)") * (2 * F.col("pos_before") + F.col("pos")).cast("decimal(19,0)"))
    agg = sc.groupBy(*groups).agg(num2.alias("_num2"), F.first("pos_total").alias("_p"),
                                  F.first("neg_total").alias("_n"))
    den = (F.col("_p").cast("decimal(18,0)") * (2 * F.col("_n")).cast("decimal(19,0)")).cast("double")
    return agg.select(*groups, F.when(den != 0, F.col("_num2").cast("double") / den).alias("auc"))


def roc_curve(scored: DataFrame, groups: list[str], label: str = "label",
              prob: str = "churn_probability") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, plus the origin point."""
    sc = score_counts(scored, groups, label, prob)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    pts = sc.select(*groups, F.col(prob).alias("threshold"),
                    _ratio(fp.cast("double"), F.col("neg_total").cast("double")).alias("fpr"),
                    _ratio(tp.cast("double"), F.col("pos_total").cast("double")).alias("tpr"))
    origin = sc.select(*groups).distinct().select(*groups, F.lit(float("inf")).alias("threshold"),
                                                  F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def metrics_long(scored: DataFrame, label: str = "label", model: str = "model_used",
                 split: str = "split", fit_on: str = "train") -> DataFrame:
    """Long metrics table (model, fit_on, split, metric, value) (M6, F5 ``metrics``). The scored rows are read
    once, into counts per (model, split, score, prediction), from which every metric follows."""
    g, prob, pred = [model, split], "churn_probability", "churn_prediction"
    table = cut_lineage(scored.groupBy(*g, prob, pred).agg(F.sum((F.col(label) == 1).cast("long")).alias("pos"),
                                                           F.sum((F.col(label) == 0).cast("long")).alias("neg")))
    cm = table.groupBy(*g).agg(*[F.sum(F.when(F.col(pred) == v, F.col(side)).otherwise(0)).alias(n) for n, v, side in
                                 (("tn", 0, "neg"), ("fp", 1, "neg"), ("fn", 0, "pos"), ("tp", 1, "pos"))])
    scores = table.groupBy(*g, prob).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    r = rates(cm, g).join(_auc_of(_with_ranks(scores, g, prob), g), g)
    names = ["precision", "recall", "f1", "auc_roc", "balanced_accuracy", "tn", "fp", "fn", "tp"]
    r = r.withColumnRenamed("auc", "auc_roc")
    return r.select(F.col(model).alias("model"), F.lit(fit_on).alias("fit_on"), F.col(split).alias("split"),
                    F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
                                        for n in names])).alias("m")).select("model", "fit_on", "split", "m.*")


def display_name(model_col="model"):
    return F.initcap(F.regexp_replace(F.col(model_col), "_", " "))


def model_summary(metrics: DataFrame) -> DataFrame:
    """One row per model: val AUC and test AUC / recall / precision / F1."""
    m = metrics.where(F.col("metric").isin("auc_roc", "recall", "precision", "f1"))
    keyed = m.select("model", F.concat(F.col("split"), F.lit("_"), F.col("metric")).alias("k"), "value")
    piv = keyed.groupBy("model").pivot("k", ["val_auc_roc", "test_auc_roc", "test_recall", "test_precision",
                                             "test_f1"]).agg(F.first("value"))
    return piv.select(display_name().alias("model_name"), "model", "val_auc_roc", "test_auc_roc", "test_recall",
                      "test_precision", "test_f1")


def best_model(metrics: DataFrame, model_order: list[str]) -> DataFrame:
    """Argmax model per (split, metric); ties go to the first model in ``model_order``."""
    order = F.array_position(F.array(*[F.lit(m) for m in model_order]), F.col("model"))
    w = Window.partitionBy("split", "metric").orderBy(F.col("value").desc(), order)
    sel = metrics.where(F.col("metric").isin("auc_roc", "f1", "precision", "recall"))
    return (sel.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)  # tiny table
            .select("split", "metric", F.col("model").alias("best_model"), F.col("value").alias("best_value")))


def target_alerts(metrics: DataFrame, model_order: list[str]) -> DataFrame:
    """Validation targets for the best model by val AUC: AUC < 0.8, recall < 0.6."""
    best = best_model(metrics, model_order).where((F.col("split") == "val") & (F.col("metric") == "auc_roc"))
    vals = metrics.where(F.col("split") == "val").join(best.select(F.col("best_model").alias("model")), "model")
    targets = F.when(F.col("metric") == "auc_roc", F.lit(K.TARGET_VAL_AUC)).when(
        F.col("metric") == "recall", F.lit(K.TARGET_VAL_RECALL))
    return (vals.where(F.col("metric").isin("auc_roc", "recall")).withColumn("target", targets)
            .where(F.col("value") < F.col("target")).select("model", "metric", "value", "target"))
