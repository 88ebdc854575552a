"""Special functions in NumPy: gamma family, normal, chi-square, t and F tails, root finding, isotonic fit."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

_gammaln = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def gammaln(x):
    return _gammaln(np.asarray(x, float))


def _shifted(x, term: Callable, series: Callable):
    """Raise the argument to 8 by the recurrence, then use the asymptotic series."""
    x = np.array(x, float, ndmin=1)
    add = np.zeros_like(x)
    while (low := x < 8).any():
        add[low] += term(x[low])
        x[low] += 1
    return add + series(x)


def digamma(x):
    out = _shifted(x, lambda v: -1 / v, lambda v: np.log(v) - 1 / (2 * v) - 1 / (12 * v**2) + 1 / (120 * v**4) - 1 / (252 * v**6) + 1 / (240 * v**8))
    return out if np.ndim(x) else float(out[0])


def trigamma(x):
    out = _shifted(x, lambda v: 1 / v**2, lambda v: 1 / v + 1 / (2 * v**2) + 1 / (6 * v**3) - 1 / (30 * v**5) + 1 / (42 * v**7) - 1 / (30 * v**9))
    return out if np.ndim(x) else float(out[0])


def norm_cdf(x):
    return 0.5 * _erfc(-np.asarray(x, float) / math.sqrt(2))


def norm_pdf(x):
    return np.exp(-0.5 * np.square(np.asarray(x, float))) / math.sqrt(2 * math.pi)


def norm_ppf(p):
    """Inverse of norm_cdf: a rough start, then Halley steps on the exact function."""
    p = np.asarray(p, float)
    q = np.minimum(p, 1 - p)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.sqrt(-2 * np.log(np.maximum(q, 1e-300)))
        x = -(t - (2.30753 + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t))
        for _ in range(5):
            e = (norm_cdf(x) - q) / np.maximum(norm_pdf(x), 1e-300)
            x = x - e / (1 + 0.5 * x * e)
    return np.where(q <= 0, -np.inf, x) * np.where(p > 0.5, -1.0, 1.0)


def gammainc_lower(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - front * h)


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def gammainc(a, x) -> np.ndarray:
    """gammainc_lower over arrays: the series below a + 1, the continued fraction above, each until all rows settle."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    some = x > 0
    front = np.zeros(a.shape)
    front[some] = np.exp(a[some] * np.log(x[some]) - x[some] - gammaln(a[some]))
    low = some & (x < a + 1)
    if low.any():
        k, term = a[low].copy(), 1 / a[low]
        total = term.copy()
        while (np.abs(term) > np.abs(total) * 1e-16).any():
            k += 1
            term = term * x[low] / k
            total += term
        out[low] = np.minimum(1.0, front[low] * total)
    high = some & ~low
    if high.any():
        aa, b = a[high], x[high] + 1 - a[high]
        c, d = np.full(b.shape, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(d == 0, 1e-300, d)
            c = b + an / c
            c = np.where(c == 0, 1e-300, c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = np.maximum(0.0, 1 - front[high] * h)
    return out


def betaincs(a, b, x) -> np.ndarray:
    """betainc over arrays, by its continued fraction."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    turn = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (x > 0) & (x < 1)
    z = np.where(inside, x, 0.5)
    front = np.exp(gammaln(a + b) - gammaln(a) - gammaln(b) + a * np.log(z) + b * np.log1p(-z)) / a
    c, d = np.ones(a.shape), 1 - (a + b) * z / (a + 1)
    d = 1 / np.where(d == 0, 1e-300, d)
    h = d.copy()
    for m in range(1, 10_000):
        for num in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(d == 0, 1e-300, d)
            c = 1 + num / c
            c = np.where(c == 0, 1e-300, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 1e-15).all():
            break
    out = np.where(inside, front * h, (x >= 1).astype(float))
    return np.where(turn, 1 - out, out)


def chi2_sf(q: float, df: float) -> float:
    return 1.0 if q <= 0 else 1 - gammainc_lower(df / 2, q / 2)


def t_sf(t: float, df: float) -> float:
    half = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return half if t > 0 else 1 - half


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_mix_sf(q: float, weights, steps: int = 4000) -> float:
    """P(sum of weights times independent chi-squares of one degree > q), by numerical inversion (Imhof)."""
    lam = np.asarray(weights, float)
    lam = lam[lam != 0]
    if not len(lam):
        return float(q < 0)
    u_max = 1.0
    while np.prod((1 + (lam * u_max) ** 2) ** 0.25) * u_max < 1e7 and u_max < 1e9:
        u_max *= 2
    u = np.linspace(0, 1, steps * max(1, int(math.log2(u_max)) + 1) + 1)[1:] ** 3 * u_max
    theta = 0.5 * np.arctan(np.outer(u, lam)).sum(axis=1) - 0.5 * q * u
    rho = np.prod((1 + np.outer(u, lam) ** 2) ** 0.25, axis=1)
    f = np.sin(theta) / (u * rho)
    at0 = 0.5 * lam.sum() - 0.5 * q
    grid, f = np.concatenate([[0], u]), np.concatenate([[at0], f])
    return float(min(1.0, max(0.0, 0.5 + np.trapezoid(f, grid) / math.pi)))


def f_mix_sf(q: float, weights, df: float) -> float:
    """P(sum of weights times chi-squares > q s), with s an independent chi-square over its df: the mixture's tail,
    averaged over s by quadrature."""
    k = 64
    at = (np.arange(k) + 0.5) / k
    lo, hi = max(1e-8, 1 - 9 * math.sqrt(2 / df)), 1 + 12 * math.sqrt(2 / df)
    s = lo + (hi - lo) * at
    log_d = (df / 2 - 1) * np.log(s) - df * s / 2
    d = np.exp(log_d - log_d.max())
    return float((d * np.array([chi2_mix_sf(q * x, weights, 600) for x in s])).sum() / d.sum())


def satterthwaite_sf(q: float, weights) -> float:
    """The same tail with a scaled chi-square of equal mean and variance."""
    lam = np.asarray(weights, float)
    scale = (lam**2).sum() / lam.sum()
    return chi2_sf(q / scale, lam.sum() ** 2 / (lam**2).sum())


def minimise(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-6, most: int = 100) -> tuple[float, float, int]:
    """Golden-section search with parabolic steps (Brent): (place, value, evaluations)."""
    gold = (3 - math.sqrt(5)) / 2
    x = w = v = lo + gold * (hi - lo)
    fx = fw = fv = f(x)
    d = e = 0.0
    n = 1
    while n < most:
        mid, t = 0.5 * (lo + hi), tol * abs(x) + 1e-12
        if abs(x - mid) <= 2 * t - 0.5 * (hi - lo):
            break
        p = q = 0.0
        if abs(e) > t:
            r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
            p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
            p = -p if q > 0 else p
            q = abs(q)
        if q and abs(p) < abs(0.5 * q * e) and q * (lo - x) < p < q * (hi - x):
            e, d = d, p / q
        else:
            e = (hi if x < mid else lo) - x
            d = gold * e
        u = x + (d if abs(d) >= t else math.copysign(t, d))
        fu = f(u)
        n += 1
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, fv, w, fw, x, fx = w, fw, x, fx, u, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, fv, w, fw = w, fw, u, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return x, fx, n


def bisect(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-10) -> float:
    """A root between two places of different sign."""
    a = f(lo)
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        b = f(mid)
        if b == 0 or hi - lo < tol * max(1.0, abs(mid)):
            return mid
        lo, hi, a = (mid, hi, b) if (a > 0) == (b > 0) else (lo, mid, a)
    return 0.5 * (lo + hi)


def isotonic(y, w=None, increasing: bool = True) -> np.ndarray:
    """Weighted least-squares monotone fit: neighbouring blocks out of order are pooled."""
    y = np.asarray(y, float) * (1 if increasing else -1)
    w = np.ones_like(y) if w is None else np.asarray(w, float)
    means, sizes, mass = [], [], []
    for value, weight in zip(y, w, strict=True):
        means.append(value)
        sizes.append(1)
        mass.append(weight)
        while len(means) > 1 and means[-2] > means[-1]:
            total = mass[-2] + mass[-1]
            merged = (means[-2] * mass[-2] + means[-1] * mass[-1]) / total if total else 0.5 * (means[-2] + means[-1])
            means[-2:], mass[-2:], sizes[-2:] = [merged], [total], [sizes[-2] + sizes[-1]]
    return np.repeat(means, sizes) * (1 if increasing else -1)


def tweedie_logpdf(y, mu, phi, p: float, w=None, limit: float = 1e14):
    """Log-density of the compound Poisson-Gamma family, 1 < p < 2; weights divide the dispersion.

    At 0 the point mass; above, the series over the number of claims, summed around its largest term, or the
    saddlepoint approximation where that term lies too far out.
    """
    y, mu = np.broadcast_arrays(np.asarray(y, float), np.asarray(mu, float))
    phi = np.broadcast_to(np.asarray(phi, float), y.shape) / (1.0 if w is None else np.asarray(w, float))
    lam = mu ** (2 - p) / (phi * (2 - p))
    out = -lam.copy()
    at = y > 0
    if at.any():
        yy, mm, ff = y[at], mu[at], phi[at]
        alpha = (2 - p) / (p - 1)
        log_z = alpha * np.log(yy) - alpha * np.log(p - 1) - (1 + alpha) * np.log(ff) - np.log(2 - p)
        top = np.maximum(1, np.round(yy ** (2 - p) / (ff * (2 - p))))
        span = np.ceil(10 * np.sqrt(top) + 20)
        far = np.exp(np.minimum(log_z, 700)) >= limit
        far |= span > 20_000
        log_w = np.zeros_like(yy)
        for i in np.flatnonzero(~far):
            j = np.arange(max(1, top[i] - span[i]), top[i] + span[i] + 1)
            t = j * log_z[i] - gammaln(j + 1) - gammaln(alpha * j)
            log_w[i] = t.max() + np.log(np.exp(t - t.max()).sum())
        exact = log_w - np.log(yy) + (yy * mm ** (1 - p) / (1 - p) - mm ** (2 - p) / (2 - p)) / ff
        unit = 2 * (yy ** (2 - p) / ((1 - p) * (2 - p)) - yy * mm ** (1 - p) / (1 - p) + mm ** (2 - p) / (2 - p))
        saddle = -0.5 * np.log(2 * math.pi * ff * yy**p) - unit / (2 * ff)
        out[at] = np.where(far, saddle, exact)
    return out
