"""Spline bases, penalties and the algebra that centres and scales them. Driver-side NumPy over small matrices."""

from __future__ import annotations

import numpy as np


def bspline_basis(x, knots, degree: int) -> np.ndarray:
    """All B-splines of a knot vector at x (rows by basis functions); the last interval is closed on the right."""
    x, knots = np.asarray(x, float), np.asarray(knots, float)
    n = len(knots) - degree - 1
    last = int(np.searchsorted(knots, knots[n], side="left")) - 1
    span = np.clip(np.searchsorted(knots, x, side="right") - 1, degree, last)
    local = np.zeros((len(x), degree + 1))
    local[:, 0] = 1.0
    for d in range(1, degree + 1):
        carried = np.zeros(len(x))
        for r in range(d):
            right, left = knots[span + r + 1], knots[span + r + 1 - d]
            width = right - left
            share = np.divide(local[:, r], width, out=np.zeros(len(x)), where=width > 0)
            local[:, r] = carried + (right - x) * share
            carried = (x - left) * share
        local[:, d] = carried
    out = np.zeros((len(x), n))
    rows = np.arange(len(x))
    for r in range(degree + 1):
        out[rows, span - degree + r] = local[:, r]
    return out


def bspline_derivative(x, knots, degree: int, order: int) -> np.ndarray:
    """The order-th derivatives of the B-splines, by differences of splines of lower degree."""
    knots = np.asarray(knots, float)
    if order == 0:
        return bspline_basis(x, knots, degree)
    lower = bspline_derivative(x, knots, degree - 1, order - 1) if degree > 0 else np.zeros((len(x), len(knots) - 1))
    n = len(knots) - degree - 1
    out = np.zeros((len(np.asarray(x)), n))
    for j in range(n):
        a, b = knots[j + degree] - knots[j], knots[j + degree + 1] - knots[j + 1]
        if a > 0:
            out[:, j] += degree / a * lower[:, j]
        if b > 0:
            out[:, j] -= degree / b * lower[:, j + 1]
    return out


def open_knots(interior, lo: float, hi: float, degree: int) -> np.ndarray:
    """Ends a thousandth of the range outside, then `degree` more knots on either side at the adjacent spacing."""
    pad = 0.001 * (hi - lo)
    inner = np.concatenate([[lo - pad], interior, [hi + pad]])
    steps = np.arange(1, degree + 1)
    return np.concatenate([inner[0] - steps[::-1] * (inner[1] - inner[0]), inner, inner[-1] + steps * (inner[-1] - inner[-2])])


def clamped_knots(interior, lo: float, hi: float, degree: int, pad: float = 0.0) -> np.ndarray:
    return np.concatenate([[lo - pad] * (degree + 1), interior, [hi + pad] * (degree + 1)])


def uniform_knots(lo: float, hi: float, n: int) -> np.ndarray:
    return np.linspace(lo, hi, n + 2)[1:-1]


def quantile_knots(values, counts, n: int, alpha: float = 0.0) -> np.ndarray:
    """Inner quantiles of distinct values, each weighted by count ** alpha, interpolated between midpoints."""
    values, w = np.asarray(values, float), np.asarray(counts, float) ** alpha
    order = np.argsort(values)
    values, w = values[order], w[order]
    at = (np.cumsum(w) - 0.5 * w) / w.sum()
    return np.interp(np.arange(1, n + 1) / (n + 1), at, values)


def difference_penalty(n: int, order: int = 2) -> np.ndarray:
    d = np.diff(np.eye(n), n=order, axis=0)
    return d.T @ d


def derivative_penalty(knots, degree: int, order: int = 2) -> np.ndarray:
    """Integral of the squared order-th derivative, by Gauss-Legendre points within each span."""
    knots = np.asarray(knots, float)
    spans = np.unique(knots[degree : len(knots) - degree])
    at, w = np.polynomial.legendre.leggauss(max(order + 1, degree))
    mid, half = (spans[1:] + spans[:-1]) / 2, (spans[1:] - spans[:-1]) / 2
    x = (mid[:, None] + half[:, None] * at).ravel()
    weights = (half[:, None] * w).ravel()
    d = bspline_derivative(x, knots, degree, order)
    return d.T @ (d * weights[:, None])


def null_space(rows: np.ndarray) -> np.ndarray:
    """Orthonormal basis of {b : rows b = 0}."""
    q, _ = np.linalg.qr(np.atleast_2d(rows).T, mode="complete")
    return q[:, np.linalg.matrix_rank(rows) :]


def natural_ends(knots, degree: int, lo: float, hi: float) -> np.ndarray:
    """Coefficients with second derivative 0 at both ends."""
    return null_space(bspline_derivative(np.array([lo, hi]), knots, degree, 2))


def cardinal_system(knots) -> tuple[np.ndarray, np.ndarray]:
    """(map from values at the knots to second derivatives there, penalty) of a natural cubic spline."""
    h = np.diff(knots)
    n = len(knots)
    d, b = np.zeros((n - 2, n)), np.zeros((n - 2, n - 2))
    for i in range(n - 2):
        d[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        b[i, i] = (h[i] + h[i + 1]) / 3
        if i < n - 3:
            b[i, i + 1] = b[i + 1, i] = h[i + 1] / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(n), inner, np.zeros(n)]), d.T @ inner


def cardinal_basis(x, knots, second: np.ndarray) -> np.ndarray:
    """Values at x of the natural cubic spline with unit value at one knot each."""
    x, knots = np.asarray(x, float), np.asarray(knots, float)
    j = np.clip(np.searchsorted(knots, x, side="right") - 1, 0, len(knots) - 2)
    h = knots[j + 1] - knots[j]
    left, right = (knots[j + 1] - x) / h, (x - knots[j]) / h
    out = np.zeros((len(x), len(knots)))
    rows = np.arange(len(x))
    out[rows, j] += left
    out[rows, j + 1] += right
    c0, c1 = (left**3 - left) * h**2 / 6, (right**3 - right) * h**2 / 6
    return out + c0[:, None] * second[j] + c1[:, None] * second[j + 1]


def centring(column_sums: np.ndarray) -> np.ndarray:
    """Basis of the coefficients whose curve sums to zero over the training rows; one column fewer."""
    return null_space(column_sums[None, :])


def whitening(gram: np.ndarray, penalty: np.ndarray, lam: float) -> np.ndarray:
    """R such that the weighted Gram plus lam times the penalty becomes the identity in the new coordinates."""
    m = gram + lam * penalty + 1e-8 * np.eye(len(gram))
    return np.linalg.inv(np.linalg.cholesky(m)).T


def row_kron(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Kronecker product."""
    return (a[:, :, None] * b[:, None, :]).reshape(len(a), -1)


def monotone_rows(n: int, direction: str) -> np.ndarray:
    """First differences of B-spline coefficients that must not be negative (convex and concave: second ones)."""
    d = np.diff(np.eye(n), n=1 if direction in ("increasing", "decreasing") else 2, axis=0)
    return d if direction in ("increasing", "convex") else -d


def solve_qp(h: np.ndarray, g: np.ndarray, a: np.ndarray, b: np.ndarray, steps: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Minimise x'hx/2 - g'x with a x >= b: a primal active-set method, from the dual by projected pivoting."""
    hinv = np.linalg.inv(h + 1e-12 * np.trace(h) / len(h) * np.eye(len(h)))
    q, r = a @ hinv @ a.T, b - a @ (hinv @ g)  # minimise u'qu/2 - r'u over u >= 0
    u, active = np.zeros(len(b)), np.zeros(len(b), bool)
    for _ in range(steps):  # Lawson and Hanson on the dual
        slope = r - q @ u
        if (slope[~active] <= tol).all():
            break
        active[np.flatnonzero(~active)[np.argmax(slope[~active])]] = True
        while True:
            at = np.flatnonzero(active)
            z = np.zeros(len(b))
            z[at] = np.linalg.lstsq(q[np.ix_(at, at)], r[at], rcond=None)[0]
            if (z[at] > 0).all():
                u = z
                break
            low = at[z[at] <= 0]
            step = np.min(u[low] / np.maximum(u[low] - z[low], 1e-300))
            u = u + step * (z - u)
            active &= u > tol
            if not active.any():
                u = np.zeros(len(b))
                break
    return hinv @ (g + a.T @ u)
