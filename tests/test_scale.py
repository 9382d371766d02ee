"""What keeps the queries' time and memory in proportion to their rows."""

import itertools
import math

import numpy as np
import pandas as pd

from retention.operators import grow as GR
from retention.operators import smote as SM
from retention.operators import tree_explain as TX


def test_a_bag_hashes_once_for_each_tree(spark):
    plan = spark.range(1).select(GR.bags("id", 5, 42).alias("b"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("md5(") == 1


def test_path_values_against_all_coalitions():
    g = np.random.default_rng(4)
    for d in (1, 2, 5, 6):
        z, o = g.random(d), TX._patterns(d)
        z[0] = 0.0
        got = TX._path_shap(z, o)
        for p in range(1 << d):
            for e in range(d):
                want, others = 0.0, [i for i in range(d) if i != e]
                for s in itertools.chain.from_iterable(itertools.combinations(others, r) for r in range(d)):
                    rest = math.prod(o[i, p] if i in s else z[i] for i in others)
                    want += math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (o[e, p] - z[e]) * rest
                assert abs(got[e, p] - want) < 1e-12


def test_a_leaf_is_computed_once_for_a_block(monkeypatch):
    """A tree of three leaves computes the values of three leaves, of their patterns and not of the rows."""
    tree = TX.TreeArrays(*map(np.array, ([1, -1, 3, -1, -1], [2, -1, 4, -1, -1], [0, -1, 1, -1, -1], [0.0, 0, 0.5, 0, 0],
                                         [0.0, 1.0, 0.0, 2.0, 4.0], [10.0, 4.0, 6.0, 3.0, 3.0])))
    sizes, one = [], TX._path_shap
    monkeypatch.setattr(TX, "_path_shap", lambda z, o: sizes.append(o.shape) or one(z, o))
    x = np.random.default_rng(1).normal(size=(5000, 2))
    phi, base = TX.shap_values([tree], x)
    assert sorted(sizes) == [(1, 2), (2, 4), (2, 4)]
    out = np.where(x[:, 0] <= 0, 1.0, np.where(x[:, 1] <= 0.5, 2.0, 4.0))
    assert np.allclose(phi.sum(axis=1) + base, out, atol=1e-12)


def _wide(spark):
    g = np.random.default_rng(0)
    x = np.c_[g.integers(0, 4, 900), g.integers(0, 2, 900), g.normal(size=900).round(2), g.integers(0, 30, 900)].astype(float)
    y = (g.random(900) < 1 / (1 + np.exp(-(x[:, 0] - 1.5 + x[:, 2] - 0.05 * x[:, 3])))).astype(int)
    return x, spark.createDataFrame([(f"k{i}", int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y))],
                                    "customerID string, label int, a double, b double, c double, d double").repartition(5)


def test_subtrees_grown_in_a_task_are_those_of_the_levels(spark, monkeypatch):
    """The same forest however many nodes are grown in tasks, in fewer jobs than it has levels."""
    x, frame = _wide(spark)
    params = {"numTrees": 6, "maxDepth": 14, "minInstancesPerNode": 1, "featureSubsetStrategy": "0.5", "minInfoGain": 0.0}
    jobs, one = [], GR.task_cells
    monkeypatch.setattr(GR, "task_cells", lambda *a, **k: jobs.append(1) or one(*a, **k))
    found = {}
    for local in (0, 150, 16384):
        jobs.clear()
        monkeypatch.setattr(GR, "LOCAL", local)
        model = GR.fit_forest(frame, list("abcd"), params, "customerID")[0]
        table = {(r.tree, tuple(_way(model, i))): (r.feature, r.threshold, r.value, r.cover) for i, r in enumerate(_nodes(model))}
        found[local] = len(jobs), table, GR.outputs(model.arrays(), 0.0, x).tolist(), model.importance().round(12).tolist(), model.table(spark).count()
    assert found[0][0] > 10 and found[16384][0] == 1 < found[150][0] < found[0][0]
    assert found[0][1:] == found[150][1:] == found[16384][1:]


def _nodes(model):
    from collections import namedtuple
    node = namedtuple("node", "tree feature threshold value cover")
    return [node(*map(float, r)) for r in zip(model.tree, model.feature, model.threshold, model.value, model.cover)]


def _way(model, i):
    """The turns from the root to a node."""
    up = {int(c): (p, s) for p, both in enumerate(zip(model.left, model.right)) for s, c in enumerate(both) if c >= 0}
    out = []
    while i in up:
        i, side = up[i]
        out.append(side)
    return out[::-1]


def test_the_driver_gets_sums_of_all_tasks(spark, monkeypatch):
    """However many tasks read the rows, a level of boosted trees brings few cells to the driver."""
    x, frame = _wide(spark)
    edges = GR.bin_edges(frame, list("abcd"))
    rows = GR.binned(frame.repartition(24), edges, "customerID", "label", GR.bags("customerID", 1, 42, 1.0))
    seen, one = [], GR.best_of_few
    monkeypatch.setattr(GR, "PER_TASK", 8 * 4 * GR.BINS)
    monkeypatch.setattr(GR, "best_of_few", lambda cells, *a: seen.append(cells.num_rows) or one(cells, *a))
    model = GR.Ensemble("boosted", list("abcd"))
    GR._grow(rows, list(edges.values()), model, [0], lambda t: 1, lambda t, path: np.arange(4), lambda *a: None, lambda gain, t: True,
             lambda t: {"alpha": 0.0, "lam": 1.0, "least": 0.0}, rounds=1)
    assert len(seen) == 1 and seen[0] == sum(len(e) + 1 for e in edges.values())


def test_a_full_share_needs_no_hash(spark):
    bag = spark.range(3).select(GR.bags("id", 4, 42, [1.0, 1.0]).alias("b"))
    assert "md5" not in bag._jdf.queryExecution().analyzed().toString() and [r.b for r in bag.collect()] == [[2] * 4] * 3


def test_bounded_neighbours_are_not_ranked(monkeypatch):
    """With a bound from the own cell a unit sorts only what lies within it."""
    g = np.random.default_rng(2)
    x, y = g.normal(size=(300, 5)), g.normal(size=(500, 5))
    left = pd.DataFrame({"vid": [f"l{i:03}" for i in range(300)], "v": list(x), "u": 1.0})
    right = pd.DataFrame({"key": [f"r{i:03}" for i in range(500)], "w": list(y)})
    d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    want = {(f"l{i:03}", f"r{j:03}") for i in range(300) for j in np.argsort(d[i])[:6] if d[i, j] <= 1.0}
    calls, one = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: calls.append(1) or one(*a, **k))
    got = SM._nearest(6)(left, right)
    assert set(zip(got.vid, got.nkey)) == want and not calls
    free = SM._nearest(6)(left.assign(u=np.inf), right)
    assert calls and len(free) == 300 * 6 and want <= set(zip(free.vid, free.nkey))
