"""Grown ensembles, their attributions and explainers against plain Python."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retention.operators import explainers as XP
from retention.operators import grow as GR
from retention.operators import models as MD
from retention.operators import tree_explain as TX

FEATURES = ["a", "b", "c", "d"]
FOREST = {"numTrees": 7, "maxDepth": 4, "minInstancesPerNode": 2, "featureSubsetStrategy": "all", "minInfoGain": 0.0}
BOOSTED = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.75", "minInfoGain": 0.05,
           "regAlpha": 0.1, "regLambda": 2.0, "minChildWeight": 1.0}


@pytest.fixture(scope="module")
def data():
    g = np.random.default_rng(0)
    x = np.c_[g.integers(0, 4, 400), g.integers(0, 2, 400), g.normal(size=400).round(2), g.integers(0, 30, 400)].astype(float)
    y = (g.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 1.5 + x[:, 2] - 0.05 * x[:, 3])))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark, data):
    x, y = data
    return spark.createDataFrame([(f"k{i}", int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))],
                                 "customerID string, label int, a double, b double, c double, d double").repartition(5)


def bag_of(spark, n, trees, share=None):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(n)], "k string")
    got = {r.k: r.bag for r in keys.select("k", GR.bags("k", trees, 42, share).alias("bag")).collect()}
    return np.array([got[f"k{i}"] for i in range(n)])


def naive_tree(x, bins, one, two, n, edges, draw, score, allowed, worth, depth, leaf, path=1):
    """The tree as nested tuples (feature, threshold, low, high) or leaf values, by trying every cut."""
    best = None
    if depth:
        total = score(one.sum(), two.sum())
        for j, f in enumerate(draw(path)):
            for cut in range(len(edges[f])):
                low = bins[:, f] <= cut
                if not allowed(n[low], n[~low], two[low].sum(), two[~low].sum()) or not n[low].sum() or not n[~low].sum():
                    continue
                gain = round(score(one[low].sum(), two[low].sum()) + score(one[~low].sum(), two[~low].sum()) - total, 9)
                if best is None or (gain, -j, -cut) > best[0]:
                    best = (gain, -j, -cut), f, cut, low
    if best is None or not worth(best[0][0]):
        return leaf(one.sum(), two.sum())
    _, f, cut, low = best
    return (f, edges[f][cut], *[naive_tree(x, bins[s], one[s], two[s], n[s], edges, draw, score, allowed, worth, depth - 1, leaf, 2 * path + i)
                                for i, s in enumerate((low, ~low))])


def run_tree(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def binned(x, edges):
    return np.column_stack([np.searchsorted(edges[i], x[:, i], side="left") for i in range(x.shape[1])])


def test_poisson_steps_are_the_distribution(spark):
    bag = bag_of(spark, 4000, 3)
    for k in range(4):
        assert abs((bag == k).mean() - math.exp(-1) / math.factorial(k)) < 0.015
    assert abs(bag_of(spark, 4000, 2, 0.8).mean() - 0.8) < 0.02


@pytest.fixture(params=["query", "numpy"])
def way(request, monkeypatch):
    if request.param == "query":
        monkeypatch.setattr(GR, "PER_TASK", 1000)


def test_forest_against_naive(spark, frame, data, way):
    x, y = data
    model, rows = GR.fit_forest(frame, FEATURES, FOREST, "customerID")
    cuts = GR.bin_edges(frame, FEATURES)
    edges, bag = [cuts[f] for f in FEATURES], bag_of(spark, len(x), 7)
    bins = binned(x, edges)
    for i in (0, 1, 3):  # few values: cut between all of them
        assert edges[i].tolist() == sorted(set(x[:, i]))[:-1]
    want = np.zeros((len(x), 7))
    for t in range(7):
        w = bag[:, t]
        n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
        w1, w0 = w.sum() / (2 * n1), w.sum() / (2 * n0)

        def score(a, b):
            p, q = w1 * a, w0 * (b - a)
            return (p * p + q * q) / (p + q) if p + q else 0.0

        use = w > 0
        tree = naive_tree(x[use], bins[use], (w * y)[use], w[use], np.ones(use.sum()), edges,
                          lambda path, t=t: np.random.default_rng([42, t, path]).permutation(4)[:4], score,
                          lambda low, high, *_: low.sum() >= 2 and high.sum() >= 2, lambda gain: gain > 1e-9, 4,
                          lambda a, b: w1 * a / (w1 * a + w0 * (b - a)) if b else 0.0)
        want[:, t] = [run_tree(tree, r) for r in x]
    assert np.allclose(GR.outputs(model.arrays(), 0.0, x), want.mean(axis=1), atol=1e-12)
    got = {r.key: r for r in GR.out_of_bag(model, rows).collect()}
    for i in range(len(x)):
        out = bag[i] == 0
        assert got[f"k{i}"].trees == out.sum()
        assert got[f"k{i}"].probability is None if not out.any() else abs(got[f"k{i}"].probability - want[i, out].mean()) < 1e-12


def test_boosting_against_naive(spark, frame, data, way):
    x, y = data
    model = GR.fit_boosted(frame, FEATURES, BOOSTED, "customerID", pos_weight=1.5)
    cuts = GR.bin_edges(frame, FEATURES)
    edges, bag = [cuts[f] for f in FEATURES], bag_of(spark, len(x), 5, 0.8)
    bins, margin, w = binned(x, edges), np.zeros(len(x)), np.where(y == 1, 1.5, 1.0)
    for t in range(5):
        p = 1 / (1 + np.exp(-margin))
        g, h = (np.rint(v * w * GR.UNIT) / GR.UNIT for v in (p - y, p * (1 - p)))
        use = bag[:, t] > 0
        columns = np.sort(np.random.default_rng([42, t]).permutation(4)[:3])

        def soft(a):
            return max(abs(a) - 0.1, 0.0)

        tree = naive_tree(x[use], bins[use], g[use], h[use], np.ones(use.sum()), edges, lambda path, c=columns: c,
                          lambda a, b: soft(a) ** 2 / (b + 2.0), lambda n, m, low, high: low >= 1 and high >= 1,
                          lambda gain: gain > 0.05, 3, lambda a, b: -0.3 * math.copysign(soft(a), a) / (b + 2.0))
        margin = margin + np.array([run_tree(tree, r) for r in x])
    assert np.allclose(GR.outputs(model.arrays(), 0.0, x), margin, atol=1e-9)


def test_boosting_side_by_side(frame, data, way, monkeypatch):
    """Each of several ensembles grown together is the one its map gives alone, also across stored margins."""
    monkeypatch.setattr(GR, "STORED", 2)
    maps = [BOOSTED, {**BOOSTED, "maxIter": 3, "maxDepth": 2, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0", "stepSize": 0.1},
            {**BOOSTED, "maxIter": 1, "subsamplingRate": 0.5, "featureSubsetStrategy": "0.5", "regAlpha": 1.0, "regLambda": 0.5,
             "minInfoGain": 0.0, "minChildWeight": 3.0}, BOOSTED]
    found = GR.fit_boosted_together(frame, FEATURES, maps, "customerID", pos_weight=1.5)
    outs = [GR.outputs(m.arrays(), 0.0, data[0]) for m in found]
    for m, p, out in zip(found, maps, outs):
        assert m.params == p and sorted(set(m.tree)) == list(range(p["maxIter"])) and len(m.roots) == p["maxIter"]
        alone = GR.fit_boosted(frame, FEATURES, p, "customerID", pos_weight=1.5)
        assert np.allclose(GR.outputs(alone.arrays(), 0.0, data[0]), out, atol=1e-12)
        assert np.allclose(alone.importance(), m.importance())
    assert not np.allclose(outs[0], outs[1]) and outs[0].tolist() == outs[3].tolist()


@pytest.fixture(scope="module")
def two_rounds(frame, data):
    return GR.outputs(GR.fit_boosted(frame, FEATURES, {**BOOSTED, "maxIter": 2}, "customerID").arrays(), 0.0, data[0])


@pytest.mark.parametrize("name, value", [("maxIter", 1), ("maxDepth", 1), ("stepSize", 0.05), ("subsamplingRate", 0.5), ("featureSubsetStrategy", "0.25"),
                                         ("minInfoGain", 5.0), ("regAlpha", 3.0), ("regLambda", 50.0)])
def test_every_parameter_has_an_effect(frame, data, two_rounds, name, value):
    other = GR.fit_boosted(frame, FEATURES, {**BOOSTED, "maxIter": 2, name: value}, "customerID")
    assert not np.allclose(two_rounds, GR.outputs(other.arrays(), 0.0, data[0]))


def test_several_jobs_a_level_and_order_of_rows(frame, data, monkeypatch):
    want = GR.fit_forest(frame, FEATURES, FOREST, "customerID")[0]
    monkeypatch.setattr(GR, "CELLS", 4 * GR.BINS * 3)  # three nodes at once
    got = GR.fit_forest(frame.repartition(2).orderBy("a"), FEATURES, FOREST, "customerID")[0]
    assert GR.outputs(got.arrays(), 0.0, data[0]).tolist() == GR.outputs(want.arrays(), 0.0, data[0]).tolist()


def test_one_class_and_few_rows(spark):
    rows = spark.createDataFrame([("a", 1, 0.0, 1.0, 2.0, 3.0)] * 3, "customerID string, label int, a double, b double, c double, d double")
    forest, bags = GR.fit_forest(rows, FEATURES, FOREST, "customerID")
    assert all(f == -1 for f in forest.feature) and set(np.unique(forest.value)) <= {0.0, 1 / 7}
    assert GR.out_of_bag(forest, bags).count() == 3
    assert GR.fit_forest(rows.limit(0), FEATURES, FOREST, "customerID")[0].value == [0.0] * 7
    assert np.isfinite(GR.fit_boosted(rows, FEATURES, BOOSTED, "customerID").value).all()


def naive_shapley(nodes, x, k):
    def value(node, known):
        _, _, f, thr, low, high, v, _ = nodes[node]
        if f < 0:
            return v
        if f in known:
            return value(low if x[f] <= thr else high, known)
        a, b = nodes[low][7], nodes[high][7]
        return (a * value(low, known) + b * value(high, known)) / (a + b)

    phi = [0.0] * k
    for f in range(k):
        others = [i for i in range(k) if i != f]
        for r in range(k):
            for s in itertools.combinations(others, r):
                w = math.factorial(r) * math.factorial(k - r - 1) / math.factorial(k)
                phi[f] += w * (value(0, {*s, f}) - value(0, set(s)))
    return phi, value(0, set())


@pytest.mark.parametrize("row_block, tree_block", [(4096, 32), (30, 2)])
def test_attributions_against_all_coalitions(spark, frame, data, row_block, tree_block):
    model, _ = GR.fit_forest(frame, FEATURES, {**FOREST, "numTrees": 5}, "customerID")
    table = model.table(spark)
    rows = frame.limit(60).unionByName(frame.limit(1))
    got = TX.attribute(table, rows, FEATURES, row_block=row_block, tree_block=tree_block).collect()
    assert len(got) == 61
    trees = {}
    for r in table.orderBy("tree", "node").collect():
        trees.setdefault(r.tree, []).append(tuple(r))
    for r in got:
        parts = [naive_shapley(t, r.x, 4) for t in trees.values()]
        assert np.allclose(r.phi, np.sum([p for p, _ in parts], axis=0), atol=1e-12)
        assert abs(r.base - sum(b for _, b in parts)) < 1e-12
    empty = TX.attribute(table.limit(0), rows, FEATURES).collect()
    assert len(empty) == 0 or all(r.phi == [0.0] * 4 for r in empty)


def test_deep_forests_are_explained_in_blocks(spark, frame, data):
    params = {**FOREST, "numTrees": 40, "maxDepth": 15, "minInstancesPerNode": 1}
    model, _ = GR.fit_forest(frame, FEATURES, params, "customerID")
    got = TX.attribute(model.table(spark), frame, FEATURES, tree_block=16).collect()
    out = GR.outputs(model.arrays(), 0.0, np.array([r.x for r in got]))
    assert len(got) == 400 and np.allclose([r.base + sum(r.phi) for r in got], out, atol=1e-9)


def test_explainers_fall_back(spark):
    from conftest import SF_SMALL
    from retention.plans.prepare import prepare
    enc = prepare(spark, SF_SMALL).encoded
    train, test = enc.where("split = 'train'"), enc.where("split = 'test'")
    fitted = [MD.fit("logistic_regression", train, {"maxIter": 50}), MD.fit("xgboost", train, {"maxIter": 3}),
              MD.fit("random_forest", train, {"numTrees": 3})]
    got = XP.global_importance(fitted, test, train)
    assert {(r.model, r.explainer) for r in got.select("model", "explainer").distinct().collect()} == {
        ("logistic_regression", "linear"), ("xgboost", "tree"), ("random_forest", "tree")}
    assert got.count() == 3 * 28

    def broken(fitted, rows, background):
        return rows.select("customerID", F.lit("m").alias("model"), F.lit("f").alias("feature"),
                           F.raise_error(F.lit("no")).cast("double").alias("contribution"))

    some = (XP.Explainer("broken", lambda m: True, broken), XP.Explainer("unsuited", lambda m: False, broken), *XP.EXPLAINERS[2:])
    found = XP.explain(fitted[1], test, train, some)
    assert {r.explainer for r in found.select("explainer").distinct().collect()} == {"sampled"}
    with pytest.raises(ValueError):
        XP.explain(fitted[1], test, train, some[:2])


def test_saved_ensembles_score_alike(spark, tmp_path):
    from conftest import SF_SMALL
    from retention.plans.prepare import prepare
    enc = prepare(spark, SF_SMALL).encoded
    fm = MD.fit("xgboost", enc.where("split = 'train'"), {"maxIter": 4})
    fm.save(str(tmp_path))
    back = MD.load(str(tmp_path), "xgboost")
    assert back.transform(enc, keep=["customerID"]).exceptAll(fm.transform(enc, keep=["customerID"])).isEmpty()
