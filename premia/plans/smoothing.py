"""Smoothing parameters by restricted likelihood, from coefficient-sized sums.

The criterion is the Laplace approximation to the restricted likelihood: with D the deviance, S the sum of the
penalties by their parameters, and H = X'WX + S,

    V = (D + b'Sb) / 2 + log|H| / 2 - log|S|+ / 2          (scale known; else the scale is profiled out).

`newton` minimises V over the logarithms of the parameters with its gradient and Hessian. Both take in that the
working weights move with the parameters, which needs one more pass over the rows an outer step, whatever the number
of penalties. `cached` finds a start without passes of its own: it minimises V at fixed working sums, which is algebra
on the driver, between two passes. `smooth` runs one after the other, the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from premia.functions.families import Family
from premia.functions.links import Link
from premia.operators.frame import Source
from premia.plans.solve import Fit, irls, padded, robust_solve, safe_inverse

LEAST, MOST = 1e-6, 1e10  # bounds of a smoothing parameter
STEP = 5.0  # the longest step of a logarithm


# -- log|S|+ and its derivatives ---------------------------------------------------------------------------------------
def blocks(parts: Sequence[np.ndarray]) -> list[tuple[list[int], np.ndarray]]:
    """(penalties, coefficients) of the groups of penalties that share coefficients."""
    support = [np.flatnonzero(np.abs(p).max(axis=0) > 0) for p in parts]
    groups: list[tuple[list[int], set[int]]] = []
    for i, s in enumerate(support):
        own, mine = [i], set(s.tolist())
        for g in [g for g in groups if g[1] & mine]:
            own, mine = g[0] + own, g[1] | mine
            groups.remove(g)
        groups.append((own, mine))
    return [(sorted(own), np.array(sorted(mine), int)) for own, mine in groups]


def _range(m: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the range of a positive semi-definite matrix."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors[:, values > 1e-9 * max(values.max(initial=0.0), 1e-300)]


def separated(parts: Sequence[np.ndarray], lams: Sequence[float]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sum of lam_i S_i, the S_i) in a basis where it can be inverted however far apart the parameters are.

    The dominant terms are diagonalised first; on the directions that they leave free the others are looked at in the
    same way, so that small terms are never added to large ones where they alone decide.
    """
    parts, lams = [np.array(p, float) for p in parts], list(lams)
    total = sum(lam * p for lam, p in zip(lams, parts, strict=True))
    at = 0
    while True:
        size = len(total) - at
        inner = [p[at:, at:] for p in parts]
        norms = [lam * float(np.linalg.norm(p)) for lam, p in zip(lams, inner, strict=True)]
        top = max(norms, default=0.0)
        large = [i for i, x in enumerate(norms) if x >= top * 1e-5]
        small = [i for i, x in enumerate(norms) if 0 < x < top * 1e-5]
        if not small or not size:
            break
        lead = sum(inner[i] / max(float(np.linalg.norm(inner[i])), 1e-300) for i in large)
        _, vectors = np.linalg.eigh(lead)
        rank = _range(lead).shape[1]
        if rank == size:
            break
        turn = np.eye(len(total))
        turn[at:, at:] = vectors[:, ::-1]  # the dominant range first
        parts = [turn.T @ p @ turn for p in parts]
        for i in large:  # nothing of the dominant terms is left in their null space
            parts[i][at + rank :, :] = 0
            parts[i][:, at + rank :] = 0
        total = sum(lam * p for lam, p in zip(lams, parts, strict=True))
        at += rank
    return total, parts


def stable_log_det(parts: Sequence[np.ndarray], lams: Sequence[float]) -> float:
    """log|sum of lam_i S_i| of full rank."""
    total, _ = separated(parts, lams)
    scale = 1 / np.sqrt(np.maximum(np.diag(total), 1e-300))
    return float(np.linalg.slogdet(total * scale[:, None] * scale)[1] - 2 * np.log(scale).sum())


class LogDet:
    """log|S|+, its rank, and its derivatives by the logarithms of the parameters, block by block.

    One penalty in a block, or penalties that commute (a surface's two margins, a smooth and the penalty on what that
    leaves free), have a closed form in their common eigenvectors; any others go through `stable_log_det`.
    """

    def __init__(self, parts: Sequence[np.ndarray]):
        self.n, self.groups, self.rank = len(parts), [], 0
        for own, at in blocks(parts):
            inner = [parts[i][np.ix_(at, at)] for i in own]
            basis = _range(sum(p / max(float(np.linalg.norm(p)), 1e-300) for p in inner))
            inner = [basis.T @ p @ basis for p in inner]
            self.rank += basis.shape[1]
            self.groups.append((own, inner, self._common(inner)))

    @staticmethod
    def _common(inner: list[np.ndarray]) -> np.ndarray | None:
        """Eigenvalues (penalties by directions) in a common basis, if there is one."""
        scaled = [p / max(float(np.linalg.norm(p)), 1e-300) for p in inner]
        if any(np.abs(a @ b - b @ a).max(initial=0.0) > 1e-10 for k, a in enumerate(scaled) for b in scaled[:k]):
            return None
        mixed = sum(p * (1 + 0.61803398875 * k) for k, p in enumerate(scaled))
        _, vectors = np.linalg.eigh(mixed)
        turned = [vectors.T @ p @ vectors for p in inner]
        if any(np.abs(t - np.diag(np.diag(t))).max(initial=0.0) > 1e-8 * max(np.abs(t).max(initial=0.0), 1e-300) for t in turned):
            return None
        found = np.array([np.diag(t) for t in turned])
        return np.where(found > 1e-9 * found.max(axis=1, keepdims=True), found, 0.0)  # rounding is no eigenvalue

    def __call__(self, lams: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(value, gradient, Hessian)."""
        value, grad, hess = 0.0, np.zeros(self.n), np.zeros((self.n, self.n))
        for own, inner, common in self.groups:
            lam = lams[own]
            if common is not None:
                each = common * lam[:, None]
                total = np.maximum(each.sum(axis=0), 1e-300)
                share = each / total
                value += float(np.log(total).sum())
                g, h = share.sum(axis=1), -share @ share.T
            else:
                total, turned = separated(inner, lam)
                scale = 1 / np.sqrt(np.maximum(np.diag(total), 1e-300))
                near_one = total * scale[:, None] * scale
                value += float(np.linalg.slogdet(near_one)[1] - 2 * np.log(scale).sum())
                each = [np.linalg.solve(near_one, x * p * scale[:, None] * scale) for x, p in zip(lam, turned, strict=True)]
                g = np.array([np.trace(e) for e in each])
                h = -np.array([[np.sum(a * b.T) for b in each] for a in each])
            grad[own] += g
            hess[np.ix_(own, own)] += h + np.diag(g)
        return value, grad, hess


# -- the criterion -----------------------------------------------------------------------------------------------------
class Criterion:
    """V with its derivatives at fitted coefficients."""

    def __init__(self, family: Family, parts: Sequence[np.ndarray], n: int):
        self.family, self.n = family, n
        self.raw, self.parts = list(parts), [padded(p) for p in parts]
        self.log_s = LogDet(parts)

    def penalty(self, lams: np.ndarray, size: int) -> np.ndarray:
        return sum((x * p for x, p in zip(lams, self.parts, strict=True)), np.zeros((size, size)))

    def free_rows(self, size: int) -> float:
        return max(self.n - (size - self.log_s.rank), 1)

    def phi(self, deviance: float, b: np.ndarray, s: np.ndarray) -> float:
        """The profiled scale: (D + b'Sb) over the rows less the unpenalised coefficients."""
        return 1.0 if self.family.scale_known else max(deviance + float(b @ s @ b), 1e-300) / self.free_rows(len(b))

    def value(self, deviance: float, h: np.ndarray, b: np.ndarray, lams: np.ndarray) -> float:
        s = self.penalty(lams, len(b))
        log_h = np.linalg.slogdet(h + s)[1]
        d, log_s = deviance + float(b @ s @ b), self.log_s(lams)[0]
        if self.family.scale_known:
            return 0.5 * (d + log_h - log_s)
        m = self.free_rows(len(b))
        return 0.5 * (m * math.log(2 * math.pi * max(d, 1e-300) / m) + m + log_h - log_s)

    def derivatives(self, deviance: float, h: np.ndarray, b: np.ndarray, lams: np.ndarray, more: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and Hessian by log(lams); more: the sums of `Source.curvature`, without which W is held fixed."""
        k, s = len(lams), self.penalty(lams, len(b))
        inv = safe_inverse(h + s)
        solve = inv if more is None else safe_inverse(more["o"] + s)
        each = [x * p for x, p in zip(lams, self.parts, strict=True)]
        moves = np.array([-solve @ (e @ b) for e in each]).reshape(k, len(b))
        _, g_s, h_s = self.log_s(lams)
        d = max(deviance + float(b @ s @ b), 1e-300)
        d1 = np.array([float(b @ e @ b) for e in each])
        d2 = np.diag(d1) + 2 * np.array([[float(b @ each[i] @ moves[j]) for j in range(k)] for i in range(k)]).reshape(k, k)
        d2 = (d2 + d2.T) / 2
        slopes = [e + (more["c"][i] if more is not None else 0.0) for i, e in enumerate(each)]
        turned = [inv @ x for x in slopes]
        g_h = np.array([np.trace(inv @ e) for e in each])
        h_h = np.diag(g_h) - np.array([[float(np.sum(a * c.T)) for c in turned] for a in turned]).reshape(k, k)
        if more is not None:
            g_h = g_h + moves @ more["g"]
            second = np.zeros((k, k))
            for i in range(k):
                for j in range(k):
                    bend = (moves[i] if i == j else 0.0) - solve @ (slopes[j] @ moves[i] + each[i] @ moves[j])
                    second[i, j] = moves[i] @ more["q"] @ moves[j] + more["g"] @ bend
            h_h = h_h + (second + second.T) / 2
        if self.family.scale_known:
            return 0.5 * (d1 + g_h - g_s), 0.5 * (d2 + h_h - h_s)
        m = self.free_rows(len(b))
        return 0.5 * (m * d1 / d + g_h - g_s), 0.5 * (m * d2 / d - m * np.outer(d1, d1) / d**2 + h_h - h_s)


def downhill(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A Newton step with the Hessian's eigenvalues made positive, no part of it longer than STEP."""
    if not len(grad):
        return grad
    values, vectors = np.linalg.eigh((hess + hess.T) / 2)
    values = np.maximum(np.abs(values), 1e-7 * max(np.abs(values).max(), 1e-300) + 1e-12)
    step = -vectors @ ((vectors.T @ grad) / values)
    return step * min(1.0, STEP / max(np.abs(step).max(), 1e-300))


def _kept_in(rho: np.ndarray) -> np.ndarray:
    return np.clip(rho, math.log(LEAST), math.log(MOST))


def _settled(rho: np.ndarray, grad: np.ndarray, tol: float) -> np.ndarray:
    """Parameters at a bound that the criterion pushes against, or flat ones (V counts degrees of freedom)."""
    low, high = rho <= math.log(LEAST) + 1e-9, rho >= math.log(MOST) - 1e-9
    return (low & (grad > 0)) | (high & (grad < 0)) | (np.abs(grad) < tol)


def cached(source: Source, family: Family, link: Link, info: dict, criterion: Criterion, lams: np.ndarray, free: list[int], *, b=None, tol: float = 1e-5, most: int = 30) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(lams, b, trace): one pass over the rows an iteration, and between passes V at the fixed working sums.

    At fixed sums the coefficients are b(lams) = (X'WX + S)^-1 X'Wz, and the deviance is that of the working response.
    """
    from premia.plans.solve import start

    b = start(source, family, link, info["mean"]) if b is None else b
    now, trace = source.sums(b, family, link), []
    for it in range(1, most + 1):
        h, g, zz = now["h"], now["g"], float(now["zz"])

        def at(rho: np.ndarray, h=h, g=g, zz=zz) -> tuple[np.ndarray, float, np.ndarray]:
            trial = np.exp(rho)
            x = robust_solve(h + criterion.penalty(trial, len(g)), g)
            return x, zz - 2 * float(x @ g) + float(x @ h @ x), trial

        rho = np.log(lams)
        x, d, trial = at(rho)
        value = criterion.value(d, h, x, trial)
        for _ in range(50 if free else 0):
            grad, hess = criterion.derivatives(d, h, x, trial)
            grad, hess = grad[free], hess[np.ix_(free, free)]
            still = ~_settled(rho[free], grad, 1e-7)
            if not still.any():
                break
            idle, step = np.flatnonzero(~still), np.zeros(len(free))
            step[still] = downhill(grad[still], np.delete(np.delete(hess, idle, 0), idle, 1))
            for _ in range(25):
                fresh = rho.copy()
                fresh[free] = _kept_in(rho[free] + step)
                x1, d1, t1 = at(fresh)
                v1 = criterion.value(d1, h, x1, t1)
                if v1 <= value + 1e-12 * abs(value):
                    break
                step = step / 2
            else:
                break
            moved, value, rho, x, d, trial = np.abs(fresh - rho).max(), v1, fresh, x1, d1, t1
            if moved < 1e-7:
                break
        shift = np.abs(rho - np.log(lams)).max(initial=0.0)
        lams, old, last = np.exp(rho), float(now["dev"]), b
        s = criterion.penalty(lams, len(x))
        goal = float(now["dev"]) + float(last @ s @ last)
        now, halvings = source.sums(x, family, link), 0
        while halvings < 8 and (not np.isfinite(now["dev"]) or (it > 1 and float(now["dev"]) + float(x @ s @ x) > goal + abs(goal))):
            x = (x + last) / 2
            now, halvings = source.sums(x, family, link), halvings + 1
        b = x
        trace.append({"iteration": it, "criterion": value, "stage": "cached", "deviance": float(now["dev"])})
        if shift < max(tol, 1e-3) and abs(float(now["dev"]) - old) < 1e-6 * (abs(old) + 0.1):
            break
    return lams, b, trace


def newton(source: Source, family: Family, link: Link, info: dict, criterion: Criterion, lams: np.ndarray, free: list[int], *, b=None, tol: float = 1e-5, most: int = 30, pirls_tol: float = 1e-8) -> tuple[Fit, np.ndarray, list[dict], bool]:
    """(fit, lams, trace, converged): damped Newton on the exact derivatives of V; steps are halved until V falls."""
    rho = _kept_in(np.log(lams))
    rho[[i for i in range(len(lams)) if i not in free]] = np.log(np.maximum(lams, 1e-300))[[i for i in range(len(lams)) if i not in free]]

    def at(r: np.ndarray, b0) -> tuple[Fit, float]:
        x = np.where(lams > 0, np.exp(r), 0.0)
        fit = irls(source, family, link, info, criterion.penalty(x, source.design.size + 1)[1:, 1:], b=b0, tol=pirls_tol)
        return fit, criterion.value(fit.deviance, fit.h, fit.b, x)

    fit, value = at(rho, b)
    trace, done = [], not free
    for it in range(1, most + 1 if free else 0):
        x = np.exp(rho)
        s = criterion.penalty(x, len(fit.b))
        inv = safe_inverse(fit.h + s)
        rough = np.array([-inv @ (lam * p @ fit.b) for lam, p in zip(x, criterion.parts, strict=True)])
        more = source.curvature(fit.b, family, link, inv, rough)
        grad, hess = criterion.derivatives(fit.deviance, fit.h, fit.b, x, more)
        grad, hess = grad[free], hess[np.ix_(free, free)]
        trace.append({"iteration": it, "criterion": value, "stage": "newton", "gradient": float(np.abs(grad).max(initial=0.0)), "deviance": fit.deviance})
        still = ~_settled(rho[free], grad, tol * 1e-1)
        if not still.any():
            done = True
            break
        idle, step = np.flatnonzero(~still), np.zeros(len(free))
        step[still] = downhill(grad[still], np.delete(np.delete(hess, idle, 0), idle, 1))
        for _ in range(12):
            fresh = rho.copy()
            fresh[free] = _kept_in(rho[free] + step)
            tried, v = at(fresh, fit.b)
            if v <= value + 1e-4 * float(grad @ (fresh[free] - rho[free])) + 1e-13 * abs(value):  # as far as V is resolved
                break
            step = step / 2
        else:
            done = True  # no descent left at working precision
            break
        moved, gain = np.abs(fresh - rho).max(), value - v
        rho, fit, value = fresh, tried, v
        if moved < tol * 1e-1 or (gain < 1e-12 * (1 + abs(value)) and it > 5):
            done = True
            break
    return fit, np.where(lams > 0, np.exp(rho), 0.0), trace, done


def smooth(source: Source, family: Family, link: Link, info: dict, named: list[tuple[str, np.ndarray, object]], *, first: float = 1e-2, tol: float = 1e-5, max_iter: int = 60, pirls_tol: float = 1e-8, constraints: np.ndarray | None = None) -> Fit:
    """The fit at the parameters that minimise V; fixed ones stay, ones that are off are 0.

    Linear constraints are put on afterwards, at the parameters of the fit without them.
    """
    parts, policies = [p for _, p, _ in named], [pol for _, _, pol in named]
    lams = np.array([p.value if p.mode != "estimate" else first * info["w"] ** 0.5 for p in policies], float)
    free = [i for i, p in enumerate(policies) if p.mode == "estimate"]
    live = [i for i in range(len(parts)) if lams[i] > 0]
    criterion = Criterion(family, [parts[i] for i in live], info["n"])
    inner = [live.index(i) for i in free]
    x, b, trace, done = lams[live], None, [], True
    if inner:
        x, b, trace = cached(source, family, link, info, criterion, x, inner, tol=tol)
    fit, x, more, done = newton(source, family, link, info, criterion, x, inner, b=b, tol=tol, most=max_iter, pirls_tol=pirls_tol)
    lams[live] = x
    if constraints is not None and len(constraints):
        fit = irls(source, family, link, info, criterion.penalty(x, source.design.size + 1)[1:, 1:], b=fit.b, tol=pirls_tol, constraints=constraints)
    s = criterion.penalty(x, len(fit.b))
    fit.lambdas = {n: float(v) for (n, _, _), v in zip(named, lams, strict=True)}
    fit.trace = [t | {"iteration": k} for k, t in enumerate([*trace, *more], 1)] or [{"iteration": 1, "criterion": criterion.value(fit.deviance, fit.h, fit.b, x)}]
    fit.converged, fit.n_iter = done and fit.converged, len(fit.trace)
    if not family.scale_known:
        fit.phi = criterion.phi(fit.deviance, fit.b, s)
    return fit
