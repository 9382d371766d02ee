"""The neighbour search against all pairs in numpy, however points are dealt into cells and chunks."""

import numpy as np
import pytest

from retention.operators import smote as SM

NAMES = ["a", "b", "c"]


def _points(spark, x):
    return spark.createDataFrame([(f"C{i}", *map(float, p)) for i, p in enumerate(x)], "customerID string, a double, b double, c double")


def _all_pairs(x, k):
    x = np.round(x, 9)
    d = np.zeros((len(x), len(x)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - x[None, :, f]) ** 2
    d = np.sqrt(d)
    return {(f"C{i}", n + 1): (name, round(dist, 9)) for i in range(len(x))
            for n, (dist, name) in enumerate(sorted((d[i, j], f"C{j}") for j in range(len(x)) if j != i)[:k])}


def _clustered():
    g = np.random.default_rng(3)
    centres = g.normal(size=(20, 3)) * 3
    near = centres[g.integers(0, 20, 200)] + np.round(g.normal(scale=0.05, size=(200, 3)), 2)
    return np.vstack([near, np.repeat(centres[:1], 90, axis=0), np.repeat(centres[1:2], 2, axis=0)])  # a third are copies


@pytest.mark.parametrize("cell, block", [(8, 16), (1024, 2048)])
def test_neighbours_equal_all_pairs(spark, monkeypatch, cell, block):
    monkeypatch.setattr(SM, "CELL", cell)
    monkeypatch.setattr(SM, "BLOCK", block)
    x = _clustered()
    got = SM.knn(_points(spark, x), 4, features=NAMES).collect()
    want = _all_pairs(x, 4)
    assert len(got) == len(want)
    for r in got:
        name, distance = want[r.customerID, r["rank"]]
        assert r.neighbor_id == name and abs(r.distance - distance) <= 1e-9
        assert list(r.neighbor_vec) == list(np.round(x[int(name[1:])], 9))


def test_ties_fall_in_the_order_of_the_keys(spark, monkeypatch):
    monkeypatch.setattr(SM, "CELL", 4)
    grid = np.array([(i, j, 0) for i in range(5) for j in range(5)], dtype=float)
    got = {(r.customerID, r["rank"]): (r.neighbor_id, r.distance) for r in SM.knn(_points(spark, grid), 5, features=NAMES).collect()}
    assert got == _all_pairs(grid, 5)


def test_cells_that_are_too_far_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(SM, "CELL", 8)
    pts = SM.with_row_key(_points(spark, _clustered()), features=NAMES).selectExpr(f"{SM.KEY} key", "customerID id", "array(a, b, c) v")
    placed, own, pivots = SM._searched(pts, 5)
    near = SM._first(SM._compare(own, placed, 5), 5)
    rest = SM._other_cells(placed, own, near, pivots, 5)
    assert rest.count() < own.count() * (len(pivots) - 1) / 4


def test_a_vector_meets_few_cells_however_many_there_are(spark, monkeypatch):
    """Vectors that differ in flags lie in cells of their own."""
    monkeypatch.setattr(SM, "CELL", 8)
    g = np.random.default_rng(5)
    flags = (np.arange(16)[:, None] >> np.arange(4)) & 1
    x = np.c_[np.repeat(flags * 2.0, 40, axis=0), np.round(g.random(640) * 4, 6)]
    pts = spark.createDataFrame([(f"C{i}", list(map(float, p))) for i, p in enumerate(x)], "id string, v array<double>").selectExpr("id key", "id", "v")
    placed, own, cuts = SM._searched(pts, 4)
    near = SM._first(SM._compare(own, placed, 4), 4)
    assert len(cuts) == 80 and SM._other_cells(placed, own, near, cuts, 4).count() < own.count() * 5


def test_few_and_odd_points(spark):
    assert SM.knn(_points(spark, np.zeros((1, 3))), 3, features=NAMES).count() == 0
    assert SM.knn(_points(spark, np.zeros((1, 3))).limit(0), 3, features=NAMES).count() == 0
    rows = [("a", 0.0, 0.0, 0.0), ("b", -0.0, 0.0, 0.0), ("c", 1.0, 0.0, 0.0), ("d", None, 0.0, 0.0), ("e", float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double")
    got = {(r.customerID, r["rank"]): (r.neighbor_id, r.distance) for r in SM.knn(df, 3, features=NAMES).collect()}
    assert got == {("a", 1): ("b", 0.0), ("a", 2): ("c", 1.0), ("b", 1): ("a", 0.0), ("b", 2): ("c", 1.0),
                   ("c", 1): ("a", 1.0), ("c", 2): ("b", 1.0)}
