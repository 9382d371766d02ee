"""Hand-computed expectations for the semantic traps (FIXTURES.md F3, SURVEY T1-T19)."""
import math

import pytest
from pyspark.sql import functions as F

from retention.functions import columns as C
from retention.operators import clv as CLV
from retention.operators import encode as EN
from retention.operators import features as FE
from retention.operators import metrics as ME
from retention.operators import score as SC


def test_tenure_bucket_modes(spark):
    df = spark.createDataFrame([(t,) for t in [0, 1, 6, 7, 12, 13, 24, 25, 72, 73]], "tenure int")
    got = {m: [r[0] for r in df.select(C.tenure_bucket("tenure", m)).collect()] for m in ("train", "score", "open")}
    assert got["train"] == [None, "0-6m", "0-6m", "6-12m", "6-12m", "12-24m", "12-24m", "24m+", "24m+", None]
    assert got["score"] == ["0-6m", "0-6m", "0-6m", "6-12m", "6-12m", "12-24m", "12-24m", "24m+", "24m+", None]
    assert got["open"] == ["0-6m", "0-6m", "0-6m", "6-12m", "6-12m", "12-24m", "12-24m", "24m+", "24m+", "24m+"]


def test_total_charges_coercion(spark):
    df = spark.createDataFrame([("29.85",), (" ",), ("abc",), (None,), ("1e3",), ("NaN",)], "TotalCharges string")
    assert [r[0] for r in FE.clean(df).collect()] == [29.85, 0.0, 0.0, 0.0, 1000.0, 0.0]


def test_missing_categories_keep_flags(spark):
    df = spark.createDataFrame([(None, "No", None, None, "Yes")],
                               "InternetService string, TechSupport string, OnlineSecurity string, OnlineBackup string, PhoneService string")
    r = df.select(C.flag_internet_no_tech_support().alias("a"), C.flag_phone_no_security().alias("b")).first()
    assert r["a"] == 1          # missing != 'No' is true (T7)
    assert r["b"] == 0          # missing == 'No' is false


def test_ratio_missing_product_stays_missing(spark):
    df = spark.createDataFrame([(10.0, None, 5.0), (10.0, 0, 5.0), (100.0, 2, 10.0)],
                               "TotalCharges double, tenure int, MonthlyCharges double")
    assert [r[0] for r in df.select(C.charge_ratio()).collect()] == [None, 10.0, 5.0]


def test_nan_is_missing_for_median(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (3.0,), (None,)], "MonthlyCharges double")
    assert FE.fit_median(df, "MonthlyCharges") == 2.0


def test_impute_inf(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (None,), (0.0,)], "a double")
    assert [r[0] for r in FE.impute(df, {"a": 7.0}).collect()] == [7.0, 7.0, 7.0, 0.0]


def test_unseen_and_missing_categories(spark):
    train = spark.createDataFrame([("Month-to-month", "0-6m"), ("One year", None), ("Two year", "24m+")],
                                  "Contract string, tenure_bucket string")
    st = EN.fit_encoder(train, ["Contract", "tenure_bucket"])
    assert st.classes("tenure_bucket") == ["0-6m", "24m+", "nan"]
    test = spark.createDataFrame([("Three year", None), (None, "12-24m")], "Contract string, tenure_bucket string")
    nan_mode = [tuple(r) for r in EN.encode(test, st, "nan").collect()]
    first_mode = [tuple(r) for r in EN.encode(test, st, "first").collect()]
    assert nan_mode == [(0, 2), (0, 0)]       # unseen -> 0; missing -> class 'nan'
    assert first_mode == [(0, 0), (0, 0)]     # parity mode: missing is unseen -> 0


def test_quartiles_with_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 3, 4, 5, 6]], "clv double")
    e = CLV.quartile_edges(df).first()
    assert (e.q1, e.q2, e.q3) == (2.0, 2.5, 4.25)
    seg = CLV.assign_quartiles(df).groupBy("clv_quartile").count()
    assert {r[0]: r[1] for r in seg.collect()} == {"Low": 4, "High": 2, "Premium": 2}


def test_quartiles_duplicate_edges_do_not_fail(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 2, 3, 4]], "clv double")
    seg = CLV.assign_quartiles(df).groupBy("clv_quartile").count()
    got = {r[0]: r[1] for r in seg.collect()}
    assert sum(got.values()) == 8 and got["Low"] == 5 and "Medium" not in got


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.12345, 2.5)], "v double, w double")
    r = df.select(F.bround("v", 4), F.bround("w", 0)).first()
    assert r[0] == 0.1234 and r[1] == 2.0


def test_metrics_with_ties_and_degenerate_classes(spark):
    rows = [(1, 0.75, "m", "s"), (0, 0.75, "m", "s"), (1, 0.5, "m", "s"), (0, 0.25, "m", "s"), (0, 0.4, "m", "s"),
            (1, 0.7, "m", "s")]
    df = spark.createDataFrame(rows, "label int, churn_probability double, model_used string, split string") \
        .withColumn("churn_prediction", (F.col("churn_probability") > 0.5).cast("int"))
    # brute force AUC: pairs (pos, neg), ties count 1/2
    pos = [p for y, p, *_ in rows if y == 1]
    neg = [p for y, p, *_ in rows if y == 0]
    want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(ME.auc(df, ["model_used", "split"]).first()["auc"], want)
    r = ME.rates(ME.confusion(df, ["model_used"]), ["model_used"]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)        # 0.5 is not > 0.5 (T19)
    one = df.where("label = 1")
    assert ME.auc(one, ["model_used"]).first()["auc"] is None
    assert ME.rates(ME.confusion(one.withColumn("churn_prediction", F.lit(0)), ["model_used"]),
                    ["model_used"]).first()["precision"] == 0.0


def test_tiers(spark):
    df = spark.createDataFrame([(p,) for p in [0.8, 0.5, 0.2, 0.7, 0.4]], "p double")
    conf = [r[0] for r in df.select(C.confidence("p")).collect()]
    act = [r[0] for r in df.select(C.action_tier("p")).collect()]
    assert conf == ["High", "Medium", "High", "Medium", "Medium"]
    assert act == ["URGENT", "MODERATE", "LOW", "MODERATE", "LOW"]


def test_empty_batch_scores_to_empty(spark):
    from retention.sources.files import RAW_SCHEMA
    empty = spark.createDataFrame([], RAW_SCHEMA)
    st = EN.EncoderState({"Contract": {"Month-to-month": 0}})
    out = SC.score(SC.features_for_scoring(empty, 70.0, st), SC.SCORECARDS["scorecard"])
    assert out.count() == 0 and len(out.columns) == 6


def test_missing_required_field_rejected(spark):
    df = spark.createDataFrame([(65.5, "x")], "MonthlyCharges double, customerID string")
    with pytest.raises(ValueError):
        SC.reject_incomplete(df)
