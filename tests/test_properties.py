"""Properties of the non-SQL operators, plan checks and file round trips."""
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from retention.functions import constants as K
from retention.operators import metrics as ME
from retention.operators import models as MD
from retention.operators import score as SC
from retention.operators import smote as SM
from retention.plans import registry as R
from retention.plans.prepare import prepare
from retention.sources import files as FS
from retention.sources.tables import customers


def test_split_proportions_and_folds(spark):
    sp = prepare(spark, SF_MID).split
    got = {(r.label, r.split): r[2] for r in sp.groupBy("label", "split").count().collect()}
    for lab in (0, 1):
        n = sum(v for (lb, _), v in got.items() if lb == lab)
        t = (n + 4) // 5
        v = (n - t + 3) // 4
        assert got[(lab, "test")] == t and got[(lab, "val")] == v and got[(lab, "train")] == n - t - v
    folds = sp.where("split = 'train'").groupBy("fold").count().collect()
    sizes = sorted(r[1] for r in folds)
    assert len(sizes) == 5 and sizes[-1] - sizes[0] <= 2
    assert sp.where("split <> 'train' and fold is not null").count() == 0
    assert sp.select("customerID").distinct().count() == sp.count()


def test_split_plan_has_no_single_partition_window(spark):
    sp = prepare(spark, SF_SMALL, checkpoint=False).split
    plan = sp._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_scoring_plan_stays_in_jvm(spark):
    scored = R._scored(spark, SF_SMALL, ["scorecard"])
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_fixture_pushdown_and_pruning(spark):
    df = customers(spark, SF_SMALL).select("customerID", "tenure")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # lineitem feeds only unused columns: the left join to its per-order aggregate is removed
    assert "lineitem" not in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    full = customers(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in full


def test_smote_points_lie_on_segments(spark):
    tr = R._scaled_train(spark, SF_SMALL)
    nn = SM.knn(tr.where("label = 1"), 5)
    over = SM.oversample(tr, ratio=1.0)
    counts = {r.label: r[1] for r in over.groupBy("label").count().collect()}
    assert counts[1] == counts[0]
    syn = over.where(F.col("customerID").contains("#smote")).collect()
    base = {r.customerID: r for r in tr.collect()}
    neigh = {(r.customerID, r.neighbor_id) for r in nn.collect()}
    for s in syn[:50]:
        src = base[s.customerID.split("#")[0]]
        # some neighbour j of src has s = src + u (j - src) with one u in [0, 1)
        ok = False
        for (a, b) in neigh:
            if a != src.customerID:
                continue
            j = base[b]
            us = set()
            for f in K.FEATURES:
                d = float(j[f]) - round(float(src[f]), 9)
                if abs(d) > 1e-9:
                    us.add(round((s[f] - round(float(src[f]), 9)) / d, 6))
            if len(us) <= 1 and all(0 <= u < 1 for u in us):
                ok = True
        assert ok


def test_models_learn_signal_and_persist(spark, tmp_out):
    enc = prepare(spark, SF_MID).encoded
    train = enc.where("split = 'train'")
    for name in ("logistic_regression", "random_forest"):
        fm = MD.fit(name, train)
        m = MD.evaluate([fm], enc.where("split = 'test'"))
        auc = m.where("metric = 'auc_roc'").first()["value"]
        assert auc >= 0.7, (name, auc)
        fm.save(tmp_out)
        back = MD.load(tmp_out, name)
        a = fm.transform(enc, keep=["customerID"]).orderBy("customerID").collect()
        b = back.transform(enc, keep=["customerID"]).orderBy("customerID").collect()
        assert a == b


def test_param_sampling_is_distinct_and_seeded():
    assert MD.param_grid_size("logistic_regression") == 36
    assert MD.param_grid_size("random_forest") == 720
    assert MD.param_grid_size("xgboost") == 972 * 9
    a = MD.sample_params("random_forest", 75)
    assert len({str(sorted(p.items())) for p in a}) == 75 and a == MD.sample_params("random_forest", 75)


def test_csv_and_split_round_trip(spark, tmp_out):
    raw = customers(spark, SF_SMALL).drop("c_custkey", "u")
    FS.write_customers_csv(raw, os.path.join(tmp_out, "c.csv"))
    back = FS.read_customers(spark, os.path.join(tmp_out, "c.csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.select(*K.RAW_COLUMNS).collect()))
    sp = prepare(spark, SF_SMALL).split
    FS.write_splits(sp, os.path.join(tmp_out, "splits"))
    tr = FS.read_split(spark, os.path.join(tmp_out, "splits"), "train")
    assert "PartitionFilters: [isnotnull(split" in tr._jdf.queryExecution().executedPlan().toString()
    assert tr.count() == sp.where("split = 'train'").count()


def test_state_and_prediction_sinks(spark, tmp_out):
    p = prepare(spark, SF_SMALL)
    from retention.operators import encode as EN
    FS.write_state(spark, tmp_out + "/state", p.encoder.to_table(spark), {"MonthlyCharges": p.median})
    enc, meds, feats = FS.read_state(spark, tmp_out + "/state")
    assert EN.EncoderState.from_table(enc).codes == p.encoder.codes and feats == K.FEATURES
    assert meds["MonthlyCharges"] == p.median
    assert FS.read_state(spark, tmp_out + "/absent")[1] == {}
    scored = R._scored(spark, SF_SMALL, ["scorecard"])
    assert FS.save_predictions(scored, tmp_out + "/pred.parquet") == "parquet"
    assert FS.save_predictions(scored, tmp_out + "/pred.json") == "csv"
    assert spark.read.option("header", True).csv(tmp_out + "/pred.json").count() == scored.count()


def test_streaming_scoring_equals_batch(spark, tmp_out):
    from retention.streaming import scoring as ST
    p = prepare(spark, SF_SMALL)
    raw = customers(spark, SF_SMALL).drop("c_custkey", "u")
    raw.select(*K.RAW_COLUMNS).write.mode("overwrite").parquet(tmp_out + "/in")
    stream = ST.read_stream(spark, tmp_out + "/in")
    q = ST.start(ST.score_stream(stream, p.median, p.encoder, SC.SCORECARDS["scorecard"]),
                 query_name="scored_test", checkpoint=tmp_out + "/ck")
    q.awaitTermination(120)
    got = spark.sql("select * from scored_test")
    batch = SC.score(SC.features_for_scoring(raw, p.median, p.encoder), SC.SCORECARDS["scorecard"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_roc_ends_at_one(spark):
    roc = R.QUERIES["roc_curve"](spark, SF_SMALL)
    mx = roc.groupBy("model_used", "split").agg(F.max("fpr").alias("f"), F.max("tpr").alias("t")).collect()
    assert all(r.f == 1.0 and r.t == 1.0 for r in mx)


@pytest.mark.parametrize("name", ["train_gbt", "cv_results"])
def test_model_queries_run(spark, name):
    rows = R.QUERIES[name](spark, SF_SMALL).collect()
    auc = [r["value"] for r in rows if r["metric"] == "auc_roc"]
    assert len(rows) == (18 if name == "train_gbt" else 2 * 5 * 2 * 4) and max(auc) > 0.5
    assert all(r["value"] is None or 0 <= r["value"] for r in rows)


@pytest.mark.parametrize("kind", ["xgboost", "random_forest"])
def test_tree_shap_local_accuracy(spark, kind):
    from retention.operators import explain as EX
    from retention.operators import tree_explain as TX
    enc = prepare(spark, SF_SMALL).encoded
    params = {"maxIter": 10, "maxDepth": 3} if kind == "xgboost" else {"numTrees": 10, "maxDepth": 4}
    fm = MD.fit(kind, enc.where("split = 'train'"), params)
    a = TX.attributions(fm, enc)
    tot = a.long().groupBy("customerID").agg(F.sum("contribution").alias("s"))
    out = fm.prepare(enc).select("customerID", fm.output().alias("f"))
    rows = tot.join(out, "customerID").collect()
    assert len(rows) == enc.count()
    assert max(abs(r.s - r.f) for r in rows) < 1e-6
    last = EX.waterfall(a.table, a, 15).where("rank = 15").select("customerID", "running").join(out, "customerID").collect()
    assert len(last) == enc.count() and max(abs(r.running - r.f) for r in last) < 1e-6


def test_sampled_shapley_local_accuracy(spark):
    assert all(r.ok for r in R.QUERIES["check_shapley"](spark, SF_SMALL).collect())


def test_check_shapley_scores_each_coalition_once(spark, monkeypatch):
    """Three checks read the values of one run: every row, draw, direction and step of its walk is scored once."""
    from retention.operators import tree_explain as TX
    scored, one = spark.sparkContext.accumulator(0), TX.predictor

    def counted(*a, **k):
        predict = one(*a, **k)

        def run(x):
            scored.add(len(x))
            return predict(x)
        return run

    monkeypatch.setattr(TX, "predictor", counted)
    assert all(r.ok for r in R.QUERIES["check_shapley"](spark, SF_SMALL).collect())
    rows = prepare(spark, SF_SMALL).encoded.where("split = 'test'").count()
    assert scored.value == rows * 24 * 2 * 29



def test_importance_sink_partitions_by_model(spark, tmp_out):
    imp = R.QUERIES["lr_importance"](spark, SF_SMALL)
    FS.save_importance(imp, tmp_out + "/imp")
    assert {"model=scorecard", "model=scorecard_b"} <= set(os.listdir(tmp_out + "/imp"))
    back = spark.read.option("header", True).csv(tmp_out + "/imp")
    assert back.count() == imp.count()


def test_batch_without_ids_gets_positional_ids(spark):
    p = prepare(spark, SF_SMALL)
    raw = customers(spark, SF_SMALL).select("tenure", "MonthlyCharges", "TotalCharges").orderBy("tenure", "MonthlyCharges")
    feats = SC.features_for_scoring(SC.with_row_index(raw), p.median, p.encoder)
    out = SC.score(feats, SC.SCORECARDS["scorecard"], row_col="row_index")
    ids = sorted(r.customer_id for r in out.collect())
    assert ids == sorted(f"customer_{i}" for i in range(raw.count()))


def test_spark_lr_as_linear_scorer(spark):
    from pyspark.ml.functions import vector_to_array
    from retention.operators import explain as EX
    from retention.operators import features as FE
    enc = prepare(spark, SF_SMALL).encoded
    fm = MD.fit("logistic_regression", enc.where("split = 'train'"), {"maxIter": 50})
    sc = SC.from_spark_lr(fm)
    imputed = FE.impute(enc, fm.medians, K.FEATURES)
    mine = imputed.select("customerID", (F.lit(1.0) / (F.lit(1.0) + F.exp(-sc.margin()))).alias("p"))
    spark_p = fm.pipeline.transform(fm.prepare(enc)).select("customerID", vector_to_array("probability")[1].alias("q"))
    rows = mine.join(spark_p, "customerID").collect()
    assert max(abs(r.p - r.q) for r in rows) < 1e-9
    assert EX.top_factors(imputed, sc, 15).count() == enc.count() * 15


@pytest.mark.parametrize("small", [20_000, 10])
def test_exact_quantiles_against_numpy(spark, monkeypatch, small):
    from retention.operators import quantile as Q
    monkeypatch.setattr(Q, "SMALL", small)
    g = np.random.default_rng(1)
    groups = {"ties": g.integers(0, 4, 30_000).astype(float), "wide": g.lognormal(0, 3, 25_001), "one": np.array([7.0]),
              "two": np.array([1.0, 2.0]), "same": np.full(500, 3.5)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in Q.exact_quantiles(df, F.col("v"), probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.allclose([got[k][f"q{i}"] for i in range(5)], np.quantile(vs, probs), rtol=1e-12), k
    assert Q.exact_quantiles(df.where("false"), F.col("v"), [0.5]).first()["q0"] is None


def test_no_percentile_merge_over_raw_values(spark):
    for name in ("median_table", "clv_quartile_edges", "churn_by_clv"):
        plan = R.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert " percentile(" not in plan, name


def test_scored_rows_are_read_once(spark):
    for name in ("score_all_models", "classification_metrics", "compare_importance"):
        plan = R.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lineitem") == 0, name
    plan = R._scored(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_smote_copies_of_an_id_are_points_of_their_own(spark, monkeypatch):
    g = np.random.default_rng(2)
    ids = [f"C{i}" for i in range(8)] + [f"C{i}" for i in range(4)]
    rows = [(i, *map(float, g.normal(size=3))) for i in ids]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double")
    for block in (2048, 3):
        monkeypatch.setattr(SM, "BLOCK", block)
        nn = SM.knn(df, 3, features=["a", "b", "c"]).collect()
        assert len(nn) == 36
        x = np.round(np.array([r[1:] for r in rows]), 9)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        want = sorted(round(v, 6) for row in np.sort(d, axis=1)[:, :3] for v in row)
        assert sorted(round(r.distance, 6) for r in nn) == want


def test_missing_probability_has_no_tier(spark):
    df = spark.createDataFrame([(None, 1.0, "a", "m", None), (0.9, 1.0, "b", "m", 1)],
                               "churn_probability double, clv double, customer_id string, model_used string, churn_prediction int")
    rows = {r.customer_id: r for r in SC.tiers(df).collect()}
    assert [rows["a"][c] for c in ("risk_label", "confidence", "gauge_band", "action_tier")] == [None] * 4
    assert [rows["b"][c] for c in ("risk_label", "confidence", "gauge_band", "action_tier")] == ["High Risk", "High", "high", "URGENT"]


def test_numeric_labels(spark):
    from retention.functions import columns as C
    df = spark.createDataFrame([(1.0, "1"), (0.0, "Yes"), (None, "No"), (2.0, "1.0")], "d double, s string")
    assert [tuple(r) for r in df.select(C.churn_label("d"), C.churn_label("s")).collect()] == [(1, 1), (0, 1), (0, 0), (0, 1)]


def test_waterfall_ends_at_the_margin(spark):
    from retention.operators import explain as EX
    enc = R._scoring_input(spark, SF_SMALL)
    w = EX.waterfall(enc, SC.DENSE, 15)
    last = w.where("rank = 15").select("customerID", "running")
    got = enc.select("customerID", SC.DENSE.margin().alias("m")).join(last, "customerID").collect()
    assert len(got) == enc.count() and max(abs(r.m - r.running) for r in got) < 1e-6


def test_training_flow(spark, tmp_out):
    from retention.plans.train import training_flow
    enc = prepare(spark, SF_SMALL).encoded
    t = training_flow(enc, tmp_out, {"logistic_regression": 1, "random_forest": 0}, folds=2)
    assert set(t.best) == {"logistic_regression", "random_forest"} and t.summary.count() == 2
    kinds = {(r.model, r.fit_on, r.split) for r in t.metrics.collect()}
    assert len(kinds) == 2 * 3
    assert spark.read.parquet(f"{tmp_out}/metrics").count() == t.metrics.count()
    assert spark.read.json(f"{tmp_out}/best_params").count() == 2
    back = MD.load(f"{tmp_out}/models", "random_forest")
    assert back.transform(enc).exceptAll(t.final["random_forest"].transform(enc)).isEmpty()


def test_a_search_goes_on_from_its_ledger(spark, tmp_out, monkeypatch):
    train = prepare(spark, SF_SMALL).encoded.where("split = 'train'")
    fits = []
    fit = MD.fit_prepared
    monkeypatch.setattr(MD, "fit_prepared", lambda m, p, x=None: fits.append(x) or fit(m, p, {**(x or {}), "maxIter": 5}))
    how = {"folds": 2, "ledger": tmp_out + "/ledger"}
    first = MD.cross_validate("logistic_regression", train, n_iter=1, **how)
    assert len(fits) == 2 and first.count() == 2 * 8
    again = MD.cross_validate("logistic_regression", train, n_iter=1, **how)
    assert len(fits) == 2 and again.exceptAll(first).isEmpty() and again.count() == first.count()
    more = MD.cross_validate("logistic_regression", train, n_iter=2, **how)  # a larger budget begins with the same maps
    assert len(fits) == 4 and more.count() == 4 * 8 and MD.best_params(more).count() == 2


def test_a_search_of_all_families_feeds_the_final_fits(spark, tmp_out, monkeypatch):
    from retention.plans import train as TR
    monkeypatch.setitem(MD.PARAM_SPACE, "logistic_regression", {"C": [0.1, 1], "maxIter": [5]})
    monkeypatch.setitem(MD.PARAM_SPACE, "random_forest", {"numTrees": [3, 4], "maxDepth": [2]})
    monkeypatch.setitem(MD.PARAM_SPACE, "xgboost", {"maxIter": [2, 4], "maxDepth": [2], "stepSize": [0.1, 0.5]})
    enc = prepare(spark, SF_SMALL).encoded
    train, budget = enc.where("split = 'train'"), {"logistic_regression": 1, "random_forest": 2, "xgboost": 3}
    t = TR.training_flow(enc, tmp_out, budget, folds=2)
    cv = TR.search_results(train, budget, 2, tmp_out + "/ledger").toPandas()
    assert len(cv) == 6 * 2 * 8 and set(cv.model) == set(budget)
    held = cv[(cv.side == "test") & (cv.metric == "auc_roc")].groupby(["model", "param_id", "params"], as_index=False).value.mean()
    for model, some in held.groupby("model"):
        top = some.sort_values(["value", "param_id"], ascending=[False, True]).iloc[0]
        assert t.best[model] == json.loads(top.params)
        assert {k: t.final[model].params[k] for k in t.best[model]} == t.best[model]
    # boosted trees of a fold are fitted together: the same metrics as one map after the other
    alone = MD.cross_validate("xgboost", train, n_iter=3, folds=2, together=1).toPandas()
    both = cv[cv.model == "xgboost"].merge(alone, on=["param_id", "params", "fold", "side", "metric"])
    assert len(both) == 3 * 2 * 8 and np.allclose(both.value_x, both.value_y, equal_nan=True)
    # started again, nothing is fitted, and no search gives the defaults
    monkeypatch.setattr(MD, "fit_maps", None)
    assert {m: p for m, (p, _) in TR.search(train, budget, 2, tmp_out + "/ledger").items()} == t.best
    assert TR.search(train, {"xgboost": 0}) == {"xgboost": (MD.DEFAULT_PARAMS["xgboost"], None)}


def test_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace
    from retention import session as S
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    spark = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError):
        S.ensure_checkpoint_dir(spark)


def test_state_faults_are_not_absence(spark, tmp_out):
    os.makedirs(tmp_out + "/state/encoder")
    with open(tmp_out + "/state/encoder/part-0.parquet", "w") as f:
        f.write("no parquet")
    with pytest.raises(Exception):
        FS.read_state(spark, tmp_out + "/state")


def test_encoder_of_many_classes_joins(spark):
    from retention.operators import encode as EN
    rows = [(i, f"v{i % 40}" if i % 7 else None, "a" if i % 2 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id int, big string, small string")
    table = EN.encoder_table(df.where("id < 200"), ["big", "small"])
    literal, joined = EN.EncoderState.from_table(table), EN.EncoderState.from_table(table, 10)
    assert set(joined.tables) == {"big"} and set(joined.codes) == {"small"}
    for null_as in ("nan", "first"):
        a, b = (EN.encode(df, s, null_as) for s in (literal, joined))
        assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert joined.to_table(spark).exceptAll(table).isEmpty()


def test_registered_searches_take_the_whole_budget(spark, monkeypatch):
    """cv_results, search_results, best_maps and train_final search as many maps as the reference, five folds each."""
    asked, fitted = [], {}

    def searched(model, train, n_iter=2, folds=5, **_):
        asked.append((model, n_iter, folds, train.select("split").distinct().collect()[0][0]))
        rows = [(model, i, json.dumps(m, sort_keys=True), 0, "test", "auc_roc", float(i)) for i, m in enumerate(MD.sample_params(model, n_iter))]
        return spark.createDataFrame(rows, MD.LEDGER)

    monkeypatch.setattr(MD, "cross_validate", searched)
    monkeypatch.setattr(MD, "refit_final", lambda m, rows, params=None: fitted.update({m: params}) or m)
    monkeypatch.setattr(MD, "evaluate", lambda models, *_, **__: models)
    whole = {("logistic_regression", 30, 5, "train"), ("random_forest", 75, 5, "train"), ("xgboost", 50, 5, "train")}
    R.QUERIES["cv_results"](spark, SF_SMALL)
    assert asked == [("logistic_regression", 30, 5, "train")]
    for name in ("search_results", "best_maps", "train_final"):
        asked.clear()
        R.QUERIES[name](spark, SF_SMALL)
        assert set(asked) == whole and len(asked) == 3
    assert fitted == {m: MD.sample_params(m, n)[-1] for m, n, *_ in whole}
