"""The versioned state store: pinning, missing parts, unfinished writers."""

import os

import pytest

from conftest import SF_SMALL
from retention.functions import constants as K
from retention.operators import models as MD
from retention.operators import score as SC
from retention.plans.prepare import prepare
from retention.sources import store as ST


def test_versions_are_pinned_and_never_half_read(spark, tmp_path):
    path = str(tmp_path / "store")
    p = prepare(spark, SF_SMALL)
    assert ST.versions(spark, path) == [] and ST.read(spark, path).version is None
    assert ST.publish(spark, path, p.encoder.to_table(spark), {"MonthlyCharges": 1.0}) == 1
    assert ST.publish(spark, path, medians={"MonthlyCharges": 2.0}, features=["tenure"]) == 2
    # a writer that died: its parts are there, its manifest is not
    p.encoder.to_table(spark).write.parquet(f"{path}/versions/3/encoder")
    assert ST.versions(spark, path) == [1, 2]
    latest, first = ST.read(spark, path), ST.read(spark, path, 1)
    assert (latest.version, latest.medians, latest.features, latest.encoder) == (2, {"MonthlyCharges": 2.0}, ["tenure"], None)
    assert (first.version, first.medians, first.features) == (1, {"MonthlyCharges": 1.0}, list(K.FEATURES))
    assert first.encoder.codes == p.encoder.codes
    with pytest.raises(ValueError):
        ST.read(spark, path, 3)
    assert ST.publish(spark, path, medians={"MonthlyCharges": 3.0}) == 3  # takes the dead writer's place
    assert ST.read(spark, path).encoder is None


def test_models_and_metrics_of_a_version(spark, tmp_path):
    path = str(tmp_path / "store")
    p = prepare(spark, SF_SMALL)
    train = p.encoded.where("split = 'train'")
    fitted = [MD.fit("logistic_regression", train, {"maxIter": 20}, smote=False), MD.fit("xgboost", train, {"maxIter": 2})]
    metrics = MD.evaluate(fitted, p.encoded.where("split <> 'train'"))
    ST.publish(spark, path, p.encoder.to_table(spark), {"MonthlyCharges": p.median}, models=fitted, metrics=metrics)
    state = ST.read(spark, path)
    want = MD.score_all(fitted, SC.features_for_scoring(p.split, p.median, p.encoder), keep=["customerID"])
    assert ST.score(state, p.split).exceptAll(want).isEmpty()
    assert state.metrics.exceptAll(metrics).isEmpty() and state.metrics.count() == metrics.count()
    with pytest.raises(ValueError):
        ST.score(ST.State(), p.split)


def test_without_any_state_the_batch_gives_it(spark, tmp_path):
    p = prepare(spark, SF_SMALL)
    got = ST.encoded(ST.read(spark, str(tmp_path / "none")), p.split)
    assert got.count() == p.split.count() and set(K.FEATURES) <= set(got.columns)


def test_faults_are_not_absence(spark, tmp_path):
    os.makedirs(tmp_path / "manifest" / "1")
    (tmp_path / "manifest" / "1" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        ST.read(spark, str(tmp_path))
