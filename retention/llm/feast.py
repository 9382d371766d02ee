"""The largest eigenpairs of a symmetric matrix by contour integration (FEAST), in numpy.

The spectrum is sliced by inertia counts: the matrix is brought to tridiagonal form once, and the signs of the pivots of the
shifted form give the number of eigenvalues above any shift. Each slice is then searched on its own. A circle around it is
discretised with Gauss-Legendre nodes; the sum of (zI - V)^-1 Q over the nodes projects a block Q onto the slice's
eigenspace, Rayleigh-Ritz extracts pairs from the block, and the step repeats until their residuals are at rounding
level. A slice counts as solved only if it holds as many pairs as its inertia count says; else the block grows, up to the
whole space. The matrix has one row per dimension of a vector, so its size does not depend on the number of rows.
"""

from __future__ import annotations

import numpy as np

NODES, PER_SLICE, MOST_STEPS = 12, 8, 30


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the same eigenvalues (Householder reflections)."""
    a = np.array(v, dtype=np.float64)
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            continue
        x[0] += np.copysign(norm, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1:, k + 1:] @ x
        p -= x * (x @ p)
        a[k + 1:, k + 1:] -= 2 * (np.outer(x, p) + np.outer(p, x))
        a[k + 1:, k] -= 2 * x * (x @ a[k + 1:, k])
        a[k, k + 1:] = a[k + 1:, k]
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(tri: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of the shifted form (Sylvester's law of inertia)."""
    diagonal, beside = tri
    tiny = np.finfo(np.float64).eps * (np.abs(diagonal).max(initial=0) + np.abs(beside).max(initial=0)) + 1e-300
    pivot, above = 1.0, 0
    for i, d in enumerate(diagonal.tolist()):
        pivot = d - shift - (float(beside[i - 1]) ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        above += pivot > 0
    return above


def _border(tri, low: float, high: float, wanted: int) -> float:
    """A shift inside a gap with ``wanted`` eigenvalues above it, or as few more as equal ones at the border demand.

    ``low`` has at least ``wanted`` eigenvalues above it, ``high`` fewer.
    """
    floor, start, width = low, low, high - low
    while high - low > 1e-13 * width:
        mid = (low + high) / 2
        above = count_above(tri, mid)
        if above < wanted:
            high = mid
        elif above > wanted:
            low = floor = mid
        else:  # inside the gap: its lower end
            top = mid
            while top - floor > 0.25 * (high - floor) and top - floor > 1e-13 * width:
                half = (top + floor) / 2
                if count_above(tri, half) > wanted:
                    floor = half
                else:
                    top = half
            return top
    equal = count_above(tri, low)  # no shift parts them: all of them, down to the next gap
    return start if equal in (wanted, count_above(tri, start)) else _border(tri, start, low, equal)


def _slices(tri, low: float, high: float) -> list[tuple[float, float, int]]:
    """Cut (low, high] into slices (low, high, eigenvalues in it) of at most PER_SLICE eigenvalues where gaps allow it."""
    done, todo = [], [(low, high)]
    while todo:
        a, b = todo.pop()
        inside = count_above(tri, a) - count_above(tri, b)
        if not inside:
            continue
        cut = next((c for f in (0.5, 0.381966, 0.618034, 0.236068, 0.763932)
                    if count_above(tri, (c := a + f * (b - a)) - 1e-4 * (b - a)) == count_above(tri, c + 1e-4 * (b - a))),
                   None) if inside > PER_SLICE else None
        if cut is None or b - a < 1e-10:  # of a trace of 1
            done.append((a, b, inside))
        else:
            todo += [(a, cut), (cut, b)]
    return sorted(done)


def contour_pairs(v: np.ndarray, low: float, high: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high) and their vectors as columns; ``inside``: how many the inertia counts promise."""
    n, eye = len(v), np.eye(len(v))
    size = min(n, 2 * inside + 4)
    norm = np.abs(v).sum(axis=1).max()
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - points)
    while True:
        block = np.random.default_rng(size).standard_normal((n, size))
        best = np.inf
        for _ in range(MOST_STEPS):
            if size < n:
                projected = np.zeros((n, size))
                for angle, weight in zip(angles, weights):
                    arm = radius * np.exp(1j * angle)
                    projected += weight / 2 * (arm * np.linalg.solve((centre + arm) * eye - v, block)).real
            else:  # the block spans the whole space: nothing to project
                projected = block
            q = np.linalg.qr(projected)[0]
            values, small = np.linalg.eigh(q.T @ v @ q)
            block = q @ small
            found = (values > low) & (values < high)
            residual = np.linalg.norm(v @ block[:, found] - block[:, found] * values[found], axis=0).max(initial=0)
            if found.sum() == inside and (residual <= 1e-14 * norm or residual > 0.5 * best):
                if residual <= 1e-11 * norm or size == n:
                    return values[found], block[:, found]
            best = min(best, residual)
        if size == n:  # the counts and the values differ in a last digit at a border: those nearest to the slice
            near = np.sort(np.argsort(np.maximum(low - values, values - high).clip(0), kind="stable")[:inside])
            return values[near], block[:, near]
        size = min(n, 2 * size)


def largest_pairs(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``most`` largest eigenvalues, falling, that are above rounding level, and unit vectors as columns.

    Equal eigenvalues get any orthonormal vectors of their space. A zero matrix, or none, has no pair.
    """
    n = len(v)
    scale = float(np.trace(v)) if n else 0.0
    if n == 0 or not scale > 0:
        return np.zeros(0), np.zeros((n, 0))
    unit = np.asarray(v, dtype=np.float64) / scale
    tri = tridiagonal(unit)
    level = 1e-13
    high = 1.25 * float(np.abs(unit).sum(axis=1).max())
    wanted = min(most, count_above(tri, level))
    low = _border(tri, level, high, wanted)
    values, vectors = [], []
    for a, b, inside in _slices(tri, low, high):
        e, w = contour_pairs(unit, a, b, inside)
        values.append(e)
        vectors.append(w)
    q = np.linalg.qr(np.concatenate(vectors, axis=1))[0]  # slices beside each other: orthogonal to the last digit
    values, small = np.linalg.eigh(q.T @ unit @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * scale, (q @ small)[:, order]
