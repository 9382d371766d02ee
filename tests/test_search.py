"""The search's own ways of growing trees: the fits are those of one map after the other."""

import numpy as np
import pytest

from conftest import SF_SMALL
from retention.functions import constants as K
from retention.operators import draws as DR
from retention.operators import grow as GR
from retention.operators import models as MD
from retention.operators import search as SE
from retention.plans.prepare import prepare

SPACES = {"random_forest": {"numTrees": [3, 6], "maxDepth": [2, 7], "minInstancesPerNode": [1, 3], "featureSubsetStrategy": ["sqrt", "0.33"],
                            "minInfoGain": [0.0, 0.01]},
          "xgboost": {"maxIter": [3, 7], "maxDepth": [1, 4], "stepSize": [0.3], "subsamplingRate": [0.7, 1.0], "featureSubsetStrategy": ["0.8", "1.0"],
                      "minInfoGain": [0, 0.1], "regAlpha": [0, 0.1], "regLambda": [0.5, 2]}}


def test_draws_are_those_of_the_generator():
    g = np.random.default_rng(5)
    tree, path = g.integers(0, 500, 300), np.r_[g.integers(1, 1 << 30, 299), 1 << 40]
    for n, m in ((28, 5), (28, 28), (4, 3), (1, 1)):
        want = [np.random.default_rng([42, int(t), int(p)]).permutation(n)[:m].tolist() for t, p in zip(tree, path)]
        assert DR.permutations(42, tree, path, n, m).tolist() == want
    assert DR._as_numpy(28)  # else each draw takes a generator of its own


@pytest.mark.parametrize("model, stored", [("random_forest", 10), ("xgboost", 3)])
def test_a_local_search_is_the_distributed_one(spark, monkeypatch, model, stored):
    monkeypatch.setitem(MD.PARAM_SPACE, model, SPACES[model])
    monkeypatch.setattr(GR, "STORED", stored)
    train = prepare(spark, SF_SMALL).encoded.where("split = 'train'")
    found = []
    for most in (SE.LOCAL_BYTES, 0):
        monkeypatch.setattr(SE, "LOCAL_BYTES", most)
        rows = MD.cross_validate(model, train, n_iter=5, folds=2).collect()
        assert len(rows) == 5 * 2 * 8
        found.append({r[:6]: r.value for r in rows})
    assert found[0] == pytest.approx(found[1], abs=1e-12, nan_ok=True)


def test_forests_that_draw_alike_are_parts_of_one(spark):
    train = prepare(spark, SF_SMALL).encoded.where("split = 'train'")
    prep = MD.prepare_fit("random_forest", train)
    maps = [{"numTrees": 6, "maxDepth": 3, "minInfoGain": 0.01}, {"numTrees": 4, "maxDepth": 9}, {"numTrees": 5, "minInstancesPerNode": 3}]
    full = [{**MD.DEFAULT_PARAMS["random_forest"], **m} for m in maps]
    assert SE.alike(full, len(K.FEATURES)) == [[0, 1], [2]]
    alone = [MD.fit_prepared("random_forest", prep, m) for m in maps]
    for a, b in zip(alone, MD.fit_maps("random_forest", prep, maps)):
        assert a.params == b.params and len(a.ensemble.feature) == len(b.ensemble.feature)
        ours, theirs = (m.transform(train, keep=["customerID"]).orderBy("customerID").toPandas().churn_probability for m in (b, a))
        assert np.allclose(ours, theirs, atol=2e-9) and np.allclose(a.ensemble.importance(), b.ensemble.importance())


def test_logistic_fits_of_a_ratio_share_their_rows(spark):
    train = prepare(spark, SF_SMALL).encoded.where("split = 'train'")
    prep = MD.prepare_fit("logistic_regression", train)
    maps = [{"C": 1.0, "penalty": "l2", "smote_ratio": 1.0}, {"C": 0.1, "penalty": "l2", "smote_ratio": 0.75}, {"C": 0.1, "penalty": "l2", "smote_ratio": 1.0}]
    for m, b in zip(maps, MD.fit_maps("logistic_regression", prep, maps)):
        a = MD.fit_prepared("logistic_regression", prep, m)
        assert a.params == b.params and a.scaling == b.scaling
        ours, theirs = (f.transform(train, keep=["customerID"]).orderBy("customerID").toPandas().churn_probability for f in (b, a))
        assert np.allclose(ours, theirs, atol=1e-6)
