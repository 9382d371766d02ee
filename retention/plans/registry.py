"""Named queries over the driver tables: one per operator of the inventory.

Each query takes (spark, sf_dir) and returns a DataFrame. Computed columns carry
the same names as in the SQL oracles (``retention.oracle``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import clv as CLV
from ..operators import encode as EN
from ..operators import encoder_stage as ES
from ..operators import explain as EX
from ..operators import explainers as XP
from ..operators import features as FE
from ..operators import grow as GR
from ..operators import metrics as ME
from ..operators import models as MD
from ..operators import score as SC
from ..operators import smote as SM
from ..operators import split as SP
from ..operators import tree_explain as TX
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from ..sources import store as ST
from ..sources.tables import customers
from . import train as TR
from .prepare import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def _prep(spark, sf_dir):
    return prepare(spark, sf_dir)


def _train(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


# like prepared state, by application and path: several queries explain or score the same fits
_FITS: dict[tuple, MD.FittedModel | MD.FittedTrees] = {}


def _fitted(spark, sf_dir, model: str, params: dict | None = None):
    """The encoded customers and the model fitted on their train split."""
    enc = _prep(spark, sf_dir).encoded
    key = (spark.sparkContext.applicationId, sf_dir, model, json.dumps(params, sort_keys=True))
    if key not in _FITS:
        _FITS[key] = MD.fit(model, _train(enc), params)
    return enc, _FITS[key]


# ------------------------------------------------------------------ sources, cleaning
@query("customers")
def q_customers(spark, sf_dir):
    return customers(spark, sf_dir)


@query("load_customers")
def q_load_customers(spark, sf_dir):
    return FE.clean(customers(spark, sf_dir)).drop("c_custkey", "u")


@query("clean_total_charges")
def q_clean_total_charges(spark, sf_dir):
    raw = customers(spark, sf_dir)
    return raw.select("customerID", F.col("TotalCharges").alias("total_charges_text"),
                      C.to_number_or_zero("TotalCharges").alias("TotalCharges"))


# ------------------------------------------------------------------ features
def _bucket_query(mode):
    def q(spark, sf_dir):
        raw = FE.clean(customers(spark, sf_dir))
        return raw.select("customerID", "tenure", C.tenure_bucket("tenure", mode).alias("tenure_bucket"))
    return q


for _m in ("train", "score", "open"):
    QUERIES[f"tenure_bucket_{_m}"] = _bucket_query(_m)


@query("services_count")
def q_services_count(spark, sf_dir):
    return _prep(spark, sf_dir).features.select("customerID", "services_count")


@query("charge_ratio")
def q_charge_ratio(spark, sf_dir):
    return _prep(spark, sf_dir).features.select("customerID", "TotalCharges", "tenure", "MonthlyCharges",
                                                "monthly_to_total_ratio")


@query("risk_flags")
def q_risk_flags(spark, sf_dir):
    return _prep(spark, sf_dir).features.select("customerID", *K.FLAG_COLUMNS)


@query("clv")
def q_clv(spark, sf_dir):
    return _prep(spark, sf_dir).features.select("customerID", "MonthlyCharges", "expected_tenure", "clv")


@query("churn_label")
def q_churn_label(spark, sf_dir):
    return customers(spark, sf_dir).select("customerID", K.TARGET, C.churn_label(K.TARGET).alias("label"))


@query("median_monthly")
def q_median_monthly(spark, sf_dir):
    return FE.exact_median(_train(_prep(spark, sf_dir).split), "MonthlyCharges")


@query("median_table")
def q_median_table(spark, sf_dir):
    return FE.median_table(_train(_prep(spark, sf_dir).encoded), K.FEATURES)


@query("impute_median")
def q_impute_median(spark, sf_dir):
    p = _prep(spark, sf_dir)
    meds = {r["column"]: r["value"] for r in FE.median_table(_train(p.encoded), K.NUMERIC_FEATURES).collect()}
    out = FE.impute(p.encoded, meds, K.NUMERIC_FEATURES)
    return out.select("customerID", *K.NUMERIC_FEATURES)


# ------------------------------------------------------------------ split
@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _prep(spark, sf_dir).split.select("customerID", "label", "split", "fold")


@query("stratified_folds")
def q_stratified_folds(spark, sf_dir):
    sp = _train(_prep(spark, sf_dir).split)
    return sp.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("customers"))


@query("scan_split")
def q_scan_split(spark, sf_dir):
    return _train(_prep(spark, sf_dir).features).select("customerID", "tenure", "MonthlyCharges", "clv", "label")


@query("train_val_union")
def q_train_val_union(spark, sf_dir):
    return (_prep(spark, sf_dir).split.where(F.col("split").isin("train", "val"))
            .select("customerID", "split", "label"))


@query("split_report")
def q_split_report(spark, sf_dir):
    return SP.split_report(_prep(spark, sf_dir).split)


@query("seeded_sample")
def q_seeded_sample(spark, sf_dir):
    test = _prep(spark, sf_dir).split.where(F.col("split") == "test")
    return SP.seeded_sample(test, 100).select("customerID", "label", "split")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return SP.class_weights(_train(_prep(spark, sf_dir).split))


@query("scale_pos_weight")
def q_scale_pos_weight(spark, sf_dir):
    return SP.scale_pos_weight(_train(_prep(spark, sf_dir).split))


@query("attach_label")
def q_attach_label(spark, sf_dir):
    p = _prep(spark, sf_dir)
    labels = customers(spark, sf_dir).select("customerID", C.churn_label(K.TARGET).alias("churn"))
    return p.encoded.select("customerID", "clv", "split").join(labels, "customerID", "inner")


# ------------------------------------------------------------------ encoding
@query("encoder_table")
def q_encoder_table(spark, sf_dir):
    return EN.encoder_table(_train(_prep(spark, sf_dir).features), K.CATEGORICAL)


@query("encode_features")
def q_encode_features(spark, sf_dir):
    return _prep(spark, sf_dir).encoded.select("customerID", *K.CATEGORICAL)


@query("encoder_stage")
def q_encoder_stage(spark, sf_dir):
    """The codes by a stage that was fitted on the train split, saved and loaded again."""
    feats = _prep(spark, sf_dir).features
    path = f"{ensure_checkpoint_dir(spark)}/encoder-{uuid.uuid4().hex}"
    Pipeline(stages=[ES.CategoryEncoder()]).fit(_train(feats)).save(path)
    return PipelineModel.load(path).transform(feats).select("customerID", *K.CATEGORICAL)


@query("encode_selffit")
def q_encode_selffit(spark, sf_dir):
    return EN.encode_selffit(_prep(spark, sf_dir).features).select("customerID", *K.CATEGORICAL)


@query("unseen_categories")
def q_unseen_categories(spark, sf_dir):
    p = _prep(spark, sf_dir)
    table = EN.encoder_table(_train(p.features), K.CATEGORICAL)
    # every customer is checked; a rule on the key plants values that training never saw
    rows = p.features.withColumns({
        "Contract": F.when(F.col("c_custkey") % 17 == 0, F.lit("Three year")).otherwise(F.col("Contract")),
        "PaymentMethod": F.when(F.col("c_custkey") % 19 == 0, F.lit("Voucher")).otherwise(F.col("PaymentMethod"))})
    return EN.unseen_categories(rows.where(F.col("split") != "train"), table)


@query("standardize")
def q_standardize(spark, sf_dir):
    p = _prep(spark, sf_dir)
    cols = ["tenure", "MonthlyCharges", "TotalCharges", "clv", "expected_tenure"]
    z = EN.standardize(p.encoded, cols, train=_train(p.encoded))
    return z.select("customerID", *[F.bround(c, 9).alias(c) for c in cols])


@query("feature_matrix")
def q_feature_matrix(spark, sf_dir):
    return EN.align_features(_prep(spark, sf_dir).encoded, K.FEATURES, keep=["customerID"])


# ------------------------------------------------------------------ CLV
def _segments(spark, sf_dir):
    return CLV.assign_quartiles(_prep(spark, sf_dir).features)


@query("clv_quartile_edges")
def q_clv_quartile_edges(spark, sf_dir):
    return CLV.quartile_edges(_prep(spark, sf_dir).features)


@query("clv_quartile")
def q_clv_quartile(spark, sf_dir):
    return _segments(spark, sf_dir).select("customerID", "clv", "clv_quartile", "segment_pos")


@query("clv_quartile_bounds")
def q_clv_quartile_bounds(spark, sf_dir):
    return CLV.quartile_bounds(_segments(spark, sf_dir))


@query("churn_by_clv")
def q_churn_by_clv(spark, sf_dir):
    return CLV.churn_by_clv(_segments(spark, sf_dir))


@query("clv_summary")
def q_clv_summary(spark, sf_dir):
    return CLV.clv_summary(_prep(spark, sf_dir).features)


@query("overall_churn")
def q_overall_churn(spark, sf_dir):
    return CLV.overall_churn(_prep(spark, sf_dir).features)


@query("segment_clv_share")
def q_segment_clv_share(spark, sf_dir):
    return CLV.segment_clv_share(_segments(spark, sf_dir))


@query("clv_histogram")
def q_clv_histogram(spark, sf_dir):
    return CLV.clv_histogram(_prep(spark, sf_dir).features)


@query("revenue_at_risk")
def q_revenue_at_risk(spark, sf_dir):
    return CLV.revenue_at_risk(CLV.churn_by_clv(_segments(spark, sf_dir)))


@query("premium_takeaway")
def q_premium_takeaway(spark, sf_dir):
    return CLV.premium_takeaway(CLV.churn_by_clv(_segments(spark, sf_dir)))


@query("clv_insights")
def q_clv_insights(spark, sf_dir):
    f = _prep(spark, sf_dir).features
    return CLV.clv_insights(f, CLV.churn_by_clv(CLV.assign_quartiles(f)))


# ------------------------------------------------------------------ scoring (frozen scorecards)
MODELS = list(SC.SCORECARDS)
FORM_FIELDS = ["customerID", "tenure", "MonthlyCharges", "Contract", "InternetService", "TechSupport",
               "OnlineSecurity", "OnlineBackup", "PhoneService", "MultipleLines", "PaymentMethod",
               "SeniorCitizen", "Partner"]


def _scoring_input(spark, sf_dir):
    """Raw customer rows through the fitted state (median, encoder) of the train split."""
    p = _prep(spark, sf_dir)
    return SC.features_for_scoring(p.split, p.median, p.encoder)


def _scored(spark, sf_dir, models=None):
    """All models in one projection over one scan: each row is scored by each and then exploded."""
    enc = EN.align_features(_scoring_input(spark, sf_dir), K.FEATURES, keep=["customerID", "label", "split"])
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), SC.SCORECARDS[m].probability().alias("p"))
                               for m in (models or MODELS)])).alias("s")
    rows = enc.select("label", "split", "clv", SC.customer_id(enc).alias("customer_id"), each)
    return rows.select("label", "split", "clv", "customer_id", F.col("s.m").alias("model_used"),
                       (F.col("s.p") > K.DECISION_THRESHOLD).cast("int").alias("churn_prediction"),
                       F.col("s.p").alias("churn_probability"), (F.lit(1.0) - F.col("s.p")).alias("no_churn_probability"),
                       C.prediction_label(F.col("s.p")).alias("prediction_label"))


@query("score_batch")
def q_score_batch(spark, sf_dir):
    return _scored(spark, sf_dir, ["scorecard"]).drop("label", "split", "clv")


@query("score_all_models")
def q_score_all_models(spark, sf_dir):
    return _scored(spark, sf_dir).drop("label", "split", "clv")


@query("score_partial_input")
def q_score_partial_input(spark, sf_dir):
    p = _prep(spark, sf_dir)
    part = customers(spark, sf_dir).select("customerID", "tenure", "MonthlyCharges", "TotalCharges")
    enc = SC.features_for_scoring(part, p.median, p.encoder)
    return SC.score(enc, SC.SCORECARDS["scorecard"])


@query("reject_incomplete")
def q_reject_incomplete(spark, sf_dir):
    _, rejected = SC.reject_incomplete(_with_gaps(FE.clean(customers(spark, sf_dir))))
    return rejected.select("customerID", "reason")


def _with_gaps(rows):
    """Every customer, with values taken away by a rule on the key: the view itself has none missing."""
    return rows.withColumns({"tenure": F.when(F.col("c_custkey") % 11 != 0, F.col("tenure")),
                             "MonthlyCharges": F.when(F.col("c_custkey") % 13 != 0, F.col("MonthlyCharges"))})


@query("score_accepted")
def q_score_accepted(spark, sf_dir):
    """The scoring chain with rejection (P14): only complete rows are scored."""
    p = _prep(spark, sf_dir)
    accepted, _ = SC.reject_incomplete(_with_gaps(FE.clean(customers(spark, sf_dir))))
    return SC.score(SC.features_for_scoring(accepted, p.median, p.encoder), SC.SCORECARDS["scorecard"])


@query("score_imputed")
def q_score_imputed(spark, sf_dir):
    """The scoring chain with imputation (P16, M11): missing numbers take the train split's median."""
    p = _prep(spark, sf_dir)
    meds = {r["column"]: r["value"] for r in FE.median_table(_train(p.encoded), K.NUMERIC_FEATURES).collect()}
    enc = SC.features_for_scoring(_with_gaps(FE.clean(customers(spark, sf_dir))), p.median, p.encoder)
    return SC.score(enc, SC.SCORECARDS["scorecard"], medians=meds)


@query("score_tiers")
def q_score_tiers(spark, sf_dir):
    return SC.tiers(_scored(spark, sf_dir, ["scorecard"]))


@query("recommended_actions")
def q_recommended_actions(spark, sf_dir):
    return SC.recommended_actions(SC.tiers(_scored(spark, sf_dir, ["scorecard"])))


@query("risk_factors")
def q_risk_factors(spark, sf_dir):
    return SC.risk_factors(FE.clean(customers(spark, sf_dir)))


@query("risk_factor_counts")
def q_risk_factor_counts(spark, sf_dir):
    return SC.risk_factor_counts(SC.risk_factors(FE.clean(customers(spark, sf_dir))))


@query("domain_violations")
def q_domain_violations(spark, sf_dir):
    return SC.domain_violations(FE.clean(customers(spark, sf_dir)))


@query("apply_form_defaults")
def q_apply_form_defaults(spark, sf_dir):
    form = customers(spark, sf_dir).select(*FORM_FIELDS)
    return SC.apply_form_defaults(form)


@query("score_summary")
def q_score_summary(spark, sf_dir):
    return SC.score_summary(_scored(spark, sf_dir))


# ------------------------------------------------------------------ metrics
def _metrics(spark, sf_dir):
    return ME.metrics_long(_scored(spark, sf_dir), fit_on="train")


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return ME.confusion(_scored(spark, sf_dir), ["model_used", "split"])


@query("classification_metrics")
def q_classification_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query("auc")
def q_auc(spark, sf_dir):
    return ME.auc(_scored(spark, sf_dir), ["model_used", "split"])


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    return ME.roc_curve(_scored(spark, sf_dir), ["model_used", "split"])


@query("model_summary")
def q_model_summary(spark, sf_dir):
    return ME.model_summary(_metrics(spark, sf_dir))


@query("best_model")
def q_best_model(spark, sf_dir):
    return ME.best_model(_metrics(spark, sf_dir), MODELS)


@query("target_alerts")
def q_target_alerts(spark, sf_dir):
    return ME.target_alerts(_metrics(spark, sf_dir), MODELS)


# ------------------------------------------------------------------ explanations
def _importance(spark, sf_dir):
    return EX.linear_importance(_train(_scoring_input(spark, sf_dir)), *SC.SCORECARDS.values())


@query("lr_importance")
def q_lr_importance(spark, sf_dir):
    return _importance(spark, sf_dir)


@query("lr_contributions")
def q_lr_contributions(spark, sf_dir):
    return EX.contributions(_scoring_input(spark, sf_dir), SC.SCORECARDS["scorecard"])


@query("top_factors")
def q_top_factors(spark, sf_dir):
    return EX.top_factors(_scoring_input(spark, sf_dir), SC.SCORECARDS["scorecard"], 15)


@query("waterfall")
def q_waterfall(spark, sf_dir):
    return EX.waterfall(_scoring_input(spark, sf_dir), SC.DENSE, 15)


@query("mean_abs_contribution")
def q_mean_abs_contribution(spark, sf_dir):
    enc = _scoring_input(spark, sf_dir)
    c = EX.contributions(enc, SC.SCORECARDS[MODELS[0]])
    for m in MODELS[1:]:
        c = c.unionByName(EX.contributions(enc, SC.SCORECARDS[m]))
    return EX.mean_abs_contribution(c)


@query("top_importance")
def q_top_importance(spark, sf_dir):
    return EX.top_importance(_importance(spark, sf_dir), 15)


@query("compare_importance")
def q_compare_importance(spark, sf_dir):
    return EX.compare_importance(_importance(spark, sf_dir), MODELS, 15)


# ------------------------------------------------------------------ SMOTE
def _scaled_train(spark, sf_dir):
    """Training rows as the logistic pipeline sees them: imputed, population z-scores."""
    train = _train(_prep(spark, sf_dir).encoded)
    meds = {r["column"]: r["value"] for r in FE.median_table(train, K.FEATURES).collect()}
    base = FE.impute(train, meds, K.FEATURES)
    scaling = EN.fit_standardizer(base, K.FEATURES)
    return base.withColumns({f: EN.standardize_expr(f, m, s) for f, (m, s) in scaling.items()})


@query("smote_knn")
def q_smote_knn(spark, sf_dir):
    mins = _scaled_train(spark, sf_dir).where(F.col("label") == 1)
    return SM.knn(mins, 5).drop("neighbor_vec", SM.KEY, "neighbor_key")


@query("smote_counts")
def q_smote_counts(spark, sf_dir):
    tr = _scaled_train(spark, sf_dir)
    return SM.smote_counts(tr, SM.oversample(tr, ratio=1.0))


@query("smote_points")
def q_smote_points(spark, sf_dir):
    tr = _scaled_train(spark, sf_dir)
    return SM.oversample(tr, ratio=1.0).where(F.col("customerID").contains("#smote"))


# ------------------------------------------------------------------ Spark ML models (no SQL oracle)
def _fit_eval(spark, sf_dir, model):
    enc = _prep(spark, sf_dir).encoded
    fm = MD.fit(model, _train(enc))
    return MD.evaluate([fm], enc.where(F.col("split") != "train"))


@query("train_logistic")
def q_train_logistic(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "logistic_regression")


@query("train_forest")
def q_train_forest(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "random_forest")


@query("train_gbt")
def q_train_gbt(spark, sf_dir):
    return _fit_eval(spark, sf_dir, "xgboost")


@query("forest_oob")
def q_forest_oob(spark, sf_dir):
    """The forest's out-of-bag AUC beside that of the rows kept out of training (M2)."""
    enc, fm = _fitted(spark, sf_dir, "random_forest")
    oob = fm.out_of_bag()
    auc = ME.auc(oob.where("probability is not null").select(F.lit("oob").alias("rows"), "label", F.round("probability", 9).alias("churn_probability")), ["rows"])
    held = fm.transform(enc.where(F.col("split") != "train"), keep=["label"]).withColumn("rows", F.lit("held_out"))
    counts = oob.agg(F.lit("oob").alias("rows"), F.count("probability").alias("scored"), F.count(F.lit(1)).alias("customers"))
    counts = counts.unionByName(held.agg(F.lit("held_out").alias("rows"), F.count("churn_probability").alias("scored"), F.count(F.lit(1)).alias("customers")))
    return counts.join(auc.unionByName(ME.auc(held, ["rows"])), "rows")


@query("forest_bags")
def q_forest_bags(spark, sf_dir):
    """Rows of each class in every tree's bag, from which its balanced weights follow."""
    train = _train(_prep(spark, sf_dir).encoded)
    rows = train.select("label", GR.bags("customerID", MD.DEFAULT_PARAMS["random_forest"]["numTrees"], MD.SEED).alias("bag"))
    return GR.bag_classes(rows)


#: features that never have more values than there are bins: a bin holds one value
FEW_VALUES = [*K.CATEGORICAL, *K.FLAG_COLUMNS, "SeniorCitizen", "services_count"]


@query("boost_histogram")
def q_boost_histogram(spark, sf_dir):
    """Gradient and hessian sums of the first level of the first boosted tree, on 0.8 of the train rows (M3)."""
    train = _train(_prep(spark, sf_dir).encoded)
    edges = GR.bin_edges(train, FEW_VALUES)
    rows = GR.binned(train, edges, "customerID", "label", GR.bags("customerID", 1, MD.SEED, 0.8))
    model = GR.Ensemble("boosted", FEW_VALUES)
    model.roots.append(model.add(0))
    weight = SP.scale_pos_weight(train).first()["scale_pos_weight"]
    cells = GR.task_cells(rows, model, [0], np.arange(len(FEW_VALUES))[None, :], weight)
    cells = GR.level_cells(cells, len(FEW_VALUES) * GR.BINS * rows.rdd.getNumPartitions())
    upper = F.array(*[F.array(*[F.lit(float(v)) for v in edges[f]]).cast("array<double>") for f in FEW_VALUES])
    names = F.array(*[F.lit(f) for f in FEW_VALUES])
    return cells.select(names[F.col("j")].alias("feature"), F.get(upper[F.col("j")], F.col("bin")).alias("upper"), "n",
                        (F.col("a") / GR.UNIT).alias("g"), (F.col("b") / GR.UNIT).alias("h"))


_LEDGERS: dict[tuple, str] = {}


def _search(spark, sf_dir):
    """The cross-validated maps of the three families, with the full budget; a ledger in the shared folder serves the later queries
    of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    ledger = _LEDGERS.setdefault(key, _new_path(spark, "search"))
    return TR.search_results(_train(_prep(spark, sf_dir).encoded), MD.SEARCH_ITERATIONS, ledger=ledger)


@query("cv_results")
def q_cv_results(spark, sf_dir):
    """The logistic family's whole search (M4)."""
    model = "logistic_regression"
    return MD.cross_validate(model, _train(_prep(spark, sf_dir).encoded), n_iter=MD.SEARCH_ITERATIONS[model], folds=5)


@query("search_results")
def q_search_results(spark, sf_dir):
    """Held-out and training metrics of every searched map, fold and family (M4)."""
    return _search(spark, sf_dir)


@query("best_maps")
def q_best_maps(spark, sf_dir):
    """The searched map of the highest mean held-out AUC of every family (M4, M5)."""
    return TR.best_maps(_search(spark, sf_dir))


@query("score_ml_models")
def q_score_ml_models(spark, sf_dir):
    enc = _prep(spark, sf_dir).encoded
    return MD.score_all([_fitted(spark, sf_dir, m)[1] for m in K.MODEL_NAMES], enc, keep=["customerID"])


@query("train_final")
def q_train_final(spark, sf_dir):
    """The best searched map of every family, fitted on train and validation rows and measured on the test split (M7)."""
    enc = _prep(spark, sf_dir).encoded
    best = {r["model"]: json.loads(r["params"]) for r in TR.best_maps(_search(spark, sf_dir)).collect()}  # three rows
    final = [MD.refit_final(m, enc, best[m]) for m in K.MODEL_NAMES]
    return MD.evaluate(final, enc.where(F.col("split") == "test"), fit_on="train+val")


# ------------------------------------------------------------------ tree explanations


@query("tree_contributions")
def q_tree_contributions(spark, sf_dir):
    """Path-dependent TreeSHAP of the boosted-trees model for every customer (I4)."""
    enc, fm = _fitted(spark, sf_dir, "xgboost")
    return TX.tree_contributions(fm, enc)


@query("frozen_tree_contributions")
def q_frozen_tree_contributions(spark, sf_dir):
    """TreeSHAP of the frozen ensemble for every customer (I4)."""
    c = TX.frozen_attributions(_scoring_input(spark, sf_dir)).long().where(F.col("feature") != "base_value")
    return c.withColumn("contribution", F.bround("contribution", 9) + F.lit(0.0))


@query("tree_top_factors")
def q_tree_top_factors(spark, sf_dir):
    """Top-15 tree attributions of the frozen ensemble for every customer."""
    a = TX.frozen_attributions(_scoring_input(spark, sf_dir))
    return EX.top_factors(a.table, a, 15).drop("coefficient")


@query("tree_waterfall")
def q_tree_waterfall(spark, sf_dir):
    """From the base value to the frozen ensemble's margin, for every customer."""
    a = TX.frozen_attributions(_scoring_input(spark, sf_dir))
    return EX.waterfall(a.table, a, 15)


@query("gbt_top_factors")
def q_gbt_top_factors(spark, sf_dir):
    """Top-15 attributions of the fitted boosted trees for every customer."""
    enc, fm = _fitted(spark, sf_dir, "xgboost")
    a = TX.attributions(fm, enc)
    return EX.top_factors(a.table, a, 15).drop("coefficient")


@query("gbt_waterfall")
def q_gbt_waterfall(spark, sf_dir):
    """From the base value to the margin of the fitted boosted trees, for every customer."""
    enc, fm = _fitted(spark, sf_dir, "xgboost")
    a = TX.attributions(fm, enc)
    return EX.waterfall(a.table, a, 15)


def _fitted_importance(spark, sf_dir):
    enc = _prep(spark, sf_dir).encoded
    return XP.global_importance([_fitted(spark, sf_dir, m)[1] for m in K.MODEL_NAMES], enc.where(F.col("split") == "test"), _train(enc))


@query("global_importance")
def q_global_importance(spark, sf_dir):
    """Mean |attribution| of the three fitted models over the test split, each by the explainer that suits it."""
    return _fitted_importance(spark, sf_dir)


@query("compare_fitted_importance")
def q_compare_fitted_importance(spark, sf_dir):
    """The 15 most important features of the three fitted models side by side (I8)."""
    return EX.compare_importance(_fitted_importance(spark, sf_dir).drop("explainer"), list(K.MODEL_NAMES), 15)


def _forest_test_shap(spark, sf_dir):
    """The forest's attributions of every test row."""
    enc, fm = _fitted(spark, sf_dir, "random_forest")
    return TX.tree_contributions(fm, enc.where(F.col("split") == "test"))


@query("tree_global_importance")
def q_tree_global_importance(spark, sf_dir):
    """Mean |SHAP| per feature of the forest over the test split."""
    c = _forest_test_shap(spark, sf_dir).where(F.col("feature") != "base_value")
    return EX.mean_abs_contribution(c)


@query("beeswarm")
def q_beeswarm(spark, sf_dir):
    """(feature, value, shap) rows of the 20 most important features."""
    c = _forest_test_shap(spark, sf_dir).where(F.col("feature") != "base_value")
    top = EX.top_importance(EX.mean_abs_contribution(c), 20).select("feature", "rank")
    return c.join(F.broadcast(top), "feature").select("customerID", "rank", "feature", "value", "contribution")


@query("default_importance")
def q_default_importance(spark, sf_dir):
    """Model-native importance of the forest and the boosted trees."""
    first, second = (TX.default_importance(_fitted(spark, sf_dir, m)[1]) for m in ("random_forest", "xgboost"))
    return first.unionByName(second)


@query("sampled_shapley")
def q_sampled_shapley(spark, sf_dir):
    """Permutation Shapley values of the logistic pipeline for every test row."""
    enc, fm = _fitted(spark, sf_dir, "logistic_regression")
    return TX.sampled_shapley(fm, enc.where(F.col("split") == "test"), _train(enc))


@query("lr_model_top_factors")
def q_lr_model_top_factors(spark, sf_dir):
    """Top-15 coefficient contributions of the fitted logistic pipeline for every customer."""
    enc, fm = _fitted(spark, sf_dir, "logistic_regression")
    return EX.top_factors(FE.impute(enc, fm.medians, K.FEATURES), SC.from_spark_lr(fm), 15)


# ------------------------------------------------------------------ invariants of the fitted models
def _checks(spark, rows: dict[str, bool]) -> DataFrame:
    return spark.createDataFrame([(k, bool(v)) for k, v in rows.items()], "name string, ok boolean")


@query("check_logistic")
def q_check_logistic(spark, sf_dir):
    """The logistic fits sit at the optimum of their penalised loss; l1 at C = 1 is no constant model (M1)."""
    train = _train(_prep(spark, sf_dir).encoded)
    prep = MD.prepare_fit("logistic_regression", train)
    rows = SM.oversample(prep.base, ratio=1.0, neighbours=prep.neighbours)
    ridge, lasso = (MD.fit_prepared("logistic_regression", prep, {"penalty": p, "C": 1.0}) for p in ("l2", "l1"))
    clf = ridge.pipeline.stages[-1]
    w = dict(zip(K.FEATURES, (float(x) for x in clf.coefficients.toArray())))
    margin = F.lit(float(clf.intercept))
    for f in K.FEATURES:
        margin = margin + F.lit(w[f]) * F.col(f)
    miss = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) - F.col("label")
    g = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(miss * F.col(f)).alias(f) for f in K.FEATURES]).first()
    residual = max(abs(g[f] + w[f] / g["n"]) for f in K.FEATURES)
    scored = ridge.transform(train, keep=["label", "split"])
    auc = ME.auc(scored, ["model_used", "split"]).first()["auc"]
    return _checks(spark, {"gradient_is_zero": residual < 1e-3, "learns_the_train_split": auc > 0.7,
                           "l1_keeps_coefficients": any(abs(x) > 1e-9 for x in lasso.pipeline.stages[-1].coefficients.toArray())})


@query("check_trees")
def q_check_trees(spark, sf_dir):
    """Attributions add up to the model's output for every customer, refits agree, importances add up to 1."""
    enc = _prep(spark, sf_dir).encoded
    rows = {}
    for m in ("random_forest", "xgboost"):
        fm, again = _fitted(spark, sf_dir, m)[1], MD.fit(m, _train(enc))
        total = TX.tree_contributions(fm, enc).groupBy("customerID").agg(
            F.sum("contribution").alias("s"), F.count(F.lit(1)).alias("n"))
        out = fm.prepare(enc).select("customerID", fm.output().alias("f"))
        r = total.join(out, "customerID").agg(F.max(F.abs(F.col("s") - F.col("f"))).alias("gap"), F.min("n").alias("lo"),
                                              F.max("n").alias("hi"), F.count(F.lit(1)).alias("rows")).first()
        rows[f"{m}_adds_up"] = r["gap"] < 1e-6
        rows[f"{m}_explains_every_customer"] = (r["lo"], r["hi"], r["rows"]) == (29, 29, enc.count())
        a, b = (x.transform(enc, keep=["customerID"]) for x in (fm, again))
        rows[f"{m}_refit_agrees"] = a.exceptAll(b).isEmpty()
        rows[f"{m}_importance_is_one"] = abs(TX.default_importance(fm).agg(F.sum("importance")).first()[0] - 1) < 1e-9
    return _checks(spark, rows)


@query("check_shapley")
def q_check_shapley(spark, sf_dir):
    """Sampled Shapley values of every test row add up to its output; against the linear margin's closed form and the train
    mean their errors are as large as the standard errors say (I5)."""
    enc, fm = _fitted(spark, sf_dir, "logistic_regression")
    test, train = enc.where(F.col("split") == "test"), _train(enc)
    found = TX.sampled_shapley(fm, test, train, margin=True).persist()  # read three times
    scorer = SC.from_spark_lr(fm)
    margin = FE.impute(test, fm.medians, K.FEATURES).select("customerID", scorer.margin().alias("m"))
    total = found.groupBy("customerID").agg(F.sum("contribution").alias("s"))
    r = total.join(margin, "customerID").agg(F.max(F.abs(F.col("s") - F.col("m"))).alias("gap"), F.count(F.lit(1)).alias("n")).first()
    # scaled by the train rows, so their mean is 0: the closed form of a feature is its own contribution
    exact = EX.contributions(FE.impute(test, fm.medians, K.FEATURES), scorer).select("customerID", "feature", F.col("contribution").alias("exact"))
    off = found.join(exact, ["customerID", "feature"]).where("std_error > 0").select((F.col("contribution") - F.col("exact")).alias("d"), "std_error")
    near = off.agg(F.avg((F.abs("d") <= 4 * F.col("std_error")).cast("double")).alias("a")).first()["a"]
    base = found.where("feature = 'base_value'").agg(F.avg("contribution").alias("b"), F.sqrt(F.sum(F.col("std_error") ** 2)).alias("e"),
                                                     F.count(F.lit(1)).alias("n")).first()
    found.unpersist()
    return _checks(spark, {"adds_up": r["gap"] < 1e-9, "explains_every_test_row": r["n"] == test.count(),
                           "errors_as_stated": near > 0.97, "base_is_the_train_mean": abs(base["b"] - scorer.intercept) <= 3 * base["e"] / base["n"]})


@query("check_search")
def q_check_search(spark, sf_dir):
    """One searched map: five folds with a held-out and a training side, from which the best map follows (M4, M5)."""
    cv = MD.cross_validate("logistic_regression", _train(_prep(spark, sf_dir).encoded), n_iter=1)
    rows, best = cv.collect(), MD.best_params(cv).collect()
    held = [r["value"] for r in rows if r["side"] == "test" and r["metric"] == "auc_roc"]
    return _checks(spark, {"folds_sides_metrics": len(rows) == 5 * 2 * 4 and len({r["fold"] for r in rows}) == 5,
                           "best_is_the_mean": len(best) == 1 and abs(best[0]["mean_test_auc"] - sum(held) / 5) < 1e-9,
                           "no_constant_model": min(held) != 0.5})


# ------------------------------------------------------------------ files: written to the shared folder and read again
def _new_path(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    """The raw customers as CSV with a header, scanned with the raw schema and cleaned."""
    path = _new_path(spark, "customers") + ".csv"
    FS.write_customers_csv(customers(spark, sf_dir), path)
    return FE.clean(FS.read_customers(spark, path))


@query("scan_split_files")
def q_scan_split_files(spark, sf_dir):
    """All splits in one partitioned dataset; the train split by partition pruning."""
    path = _new_path(spark, "splits")
    FS.write_splits(_prep(spark, sf_dir).features.select("customerID", "tenure", "MonthlyCharges", "clv", "label", "split"), path)
    return FS.read_split(spark, path, "train").drop("split")


@query("prediction_sink")
def q_prediction_sink(spark, sf_dir):
    """Scored rows saved as parquet."""
    path = _new_path(spark, "predictions") + ".parquet"
    FS.save_predictions(QUERIES["score_batch"](spark, sf_dir), path)
    return spark.read.parquet(path)


@query("score_saved_state")
def q_score_saved_state(spark, sf_dir):
    """Scores from a published version of the fitted state: those of the state in memory."""
    p, path = _prep(spark, sf_dir), _new_path(spark, "state")
    ST.publish(spark, path, p.encoder.to_table(spark), {"MonthlyCharges": p.median + 1.0})
    ST.publish(spark, path, p.encoder.to_table(spark), {"MonthlyCharges": p.median}, list(K.FEATURES))
    state = ST.read(spark, path)
    rows = EN.align_features(ST.encoded(state, p.split), state.features, keep=["customerID"])
    return SC.score(rows, SC.SCORECARDS["scorecard"])


@query("score_missing_medians")
def q_score_missing_medians(spark, sf_dir):
    """The published version has no medians: the batch's own median takes their place."""
    path = _new_path(spark, "state")
    p = _prep(spark, sf_dir)
    ST.publish(spark, path, p.encoder.to_table(spark))
    rows = ST.encoded(ST.read(spark, path), p.split)
    return rows.select("customerID", "premium_no_backup", "long_tenure_low_value",
                       SC.SCORECARDS["scorecard"].probability().alias("churn_probability"))


@query("importance_sink")
def q_importance_sink(spark, sf_dir):
    """Importances saved as CSV, one folder per model."""
    path = _new_path(spark, "importance")
    FS.save_importance(QUERIES["lr_importance"](spark, sf_dir), path)
    schema = "feature string, importance double, coefficient double, std_dev double, model string"
    return spark.read.option("header", True).schema(schema).csv(path)
