"""Contour integration and embedding whitening against numpy's own eigenvalues."""

import math

import numpy as np
import pytest

from retention.llm import whitening
from retention.llm.feast import count_above, largest_pairs, tridiagonal

NAN, INF = float("nan"), float("inf")


def spaces(v, most):
    e, w = largest_pairs(v, most)
    assert np.allclose(w.T @ w, np.eye(len(e)), atol=1e-13)
    assert np.abs(v @ w - w * e).max(initial=0) <= 1e-12 * max(1.0, np.abs(v).max())
    assert np.allclose(e, np.linalg.eigvalsh(v)[::-1][:len(e)], rtol=1e-11, atol=1e-12 * np.abs(v).max())
    return e


@pytest.mark.parametrize("dims, rank", [(1, 1), (2, 2), (5, 5), (40, 3), (64, 64), (90, 90)])
def test_pairs_of_random_matrices(dims, rank):
    a = np.random.default_rng(dims).standard_normal((dims, rank))
    assert len(spaces(a @ a.T, 16)) == min(16, rank)


def test_pairs_of_equal_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((40, 40)))[0]
    for values in ([3.0] * 40, [5.0] * 10 + [1.0] * 30, [1e6] + [2.0] * 39, [4.0] * 16 + [0.0] * 24, [9, 8, 8, 8, 7] + [1e-3] * 35):
        v = q * np.array(values) @ q.T
        assert len(spaces((v + v.T) / 2, 16)) == min(16, np.count_nonzero(values))
    assert len(largest_pairs(np.zeros((4, 4)), 16)[0]) == 0 and len(largest_pairs(np.zeros((0, 0)), 16)[0]) == 0


def test_inertia_counts():
    a = np.random.default_rng(7).standard_normal((30, 30))
    v = a + a.T
    values = np.linalg.eigvalsh(v)
    for shift in np.linspace(values[0] - 1, values[-1] + 1, 50):
        assert count_above(tridiagonal(v), shift) == (values > shift).sum()


def naive(rows, dims, most=16):
    """(id, deviation) of the usable rows, the whitened values up to sign, and the shares of the trace."""
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64).reshape(-1, dims)
    n, sums = len(fit), fit.sum(axis=0)
    if not n:
        return good, [], np.zeros((0, 0)), []
    c = fit - sums / n
    e, w = np.linalg.eigh(c.T @ c / n)
    keep = [k for k in np.argsort(-e)[:most] if e[k] > 1e-12 * max(e.sum(), 1e-300)]
    white = [[(np.array(x) - sums / n) @ w[:, k] / np.sqrt(e[k]) for k in keep] for _, x in good]
    deviation = [sum((n * a - int(b)) ** 2 for a, b in zip(x, sums)) for _, x in good]
    return good, deviation, np.array(white), [e[k] / e.sum() for k in keep]


def check(spark, rows, dims, schema="name string, vec_id bigint, embedding array<float>, _x int, n int"):
    df = spark.createDataFrame([("a", i, v, 1, 2) for i, v in rows], schema)
    model = whitening.fit(df)
    got = whitening.transform(df, model).collect()
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    good, deviation, white, share = naive(rows, dims)
    k = len(share)
    assert len(got) == len(good) * k
    mine = sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.deviation) for r in got)
    assert mine == sorted((i if i is not None else -1, c + 1, d) for (i, _), d in zip(good, deviation) for c in range(k))
    by = {(r.vec_id, r.component): r for r in got}
    for (i, _), w in zip(good, white):
        for c in range(k):
            assert abs(by[i, c + 1].explained - share[c]) < 1e-9
    if k and len({round(s, 9) for s in share}) == k:  # distinct eigenvalues: columns equal up to sign
        for c in range(k):
            a = np.array([by[i, c + 1].whitened for i, _ in good])
            assert min(np.abs(a - white[:, c]).max(), np.abs(a + white[:, c]).max()) < 1e-6
    assert all(r.identity_error < 1e-8 for r in got)
    return got


def test_rows_against_numpy(spark):
    g = np.random.default_rng(1)
    scale = np.linspace(3, 0.3, 20)
    rows = [(i, (g.standard_normal(20) * scale).tolist()) for i in range(300)]
    assert len(check(spark, rows, 20)) == 300 * 16
    # copies count once in the fit
    assert len(check(spark, rows + [(1000 + i, rows[0][1]) for i in range(200)], 20)) == 500 * 16


def test_odd_vectors(spark):
    ok = [(i, [float(i), float(i * i % 7), 1.0]) for i in range(9)]
    odd = [(20, None), (21, []), (22, [1.0, None, 2.0]), (23, [NAN, 1.0, 1.0]), (24, [1.0, INF, 1.0]), (25, [1.0, -INF, 0.0]),
           (26, [1.0, 2.0]), (27, [1e30, 0.0, 0.0]), (None, [2.0, 2.0, 1.0])]
    got = check(spark, ok + odd[:7] + odd[8:], 3)
    assert {r.component for r in got} == {1, 2}  # the third entry does not vary
    df = spark.createDataFrame(ok + odd, "vec_id bigint, embedding array<float>")
    assert {r.vec_id for r in whitening.transform(df, whitening.fit(df)).collect()} == {*range(9), None}


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])] * 5):
        df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
        got = whitening.transform(df, whitening.fit(df))
        assert got.count() == 0 and got.columns[0] == "vec_id"


def test_exact_deviations_of_large_codes(spark):
    rows = [(1, [1e12, 1.0]), (2, [-1e12, 0.5]), (3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * a - b) ** 2 for a, b in zip(v, s)) for (i, _), v in zip(rows, x)}
    got = whitening.transform(df, whitening.fit(df)).collect()
    assert {r.vec_id: r.deviation for r in got} == {i: d if d < 1 << 63 else None for i, d in want.items()}
    assert {r.deviation for r in got} != {None}


def test_query(spark):
    import retention.llm.queries as q

    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    good, deviation, white, share = naive(rows, len(rows[0][1]))
    got = q.op11_whitening(spark, sf).collect()
    assert len(got) == 16 * len(rows) and max(r.identity_error for r in got) < 1e-9
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d) for (i, _), d in zip(good, deviation)}
    assert np.allclose([r.explained for r in sorted(got, key=lambda r: r.component)][::len(rows)], share, rtol=1e-9)
