"""Solvers on the driver: they see coefficient-sized sums, never rows.

`irls` handles quadratic penalties and linear constraints, `block_descent` group penalties, `path` a sequence of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from premia.functions.families import Family
from premia.functions.links import Link
from premia.operators import splines
from premia.operators.frame import Source


@dataclass
class Fit:
    """A solver's result; b holds the intercept first."""

    b: np.ndarray
    deviance: float
    pearson: float
    n_iter: int
    converged: bool
    h: np.ndarray
    penalty: np.ndarray
    n: int
    edf: float = math.nan
    phi: float = 1.0
    score: np.ndarray | None = None
    lambdas: dict[str, float] = field(default_factory=dict)
    trace: list[dict] = field(default_factory=list)
    inv: np.ndarray | None = None  # where the inverse is not that of h + penalty

    @property
    def beta(self) -> np.ndarray:
        return self.b[1:]

    @property
    def intercept(self) -> float:
        return float(self.b[0])

    @property
    def inverse(self) -> np.ndarray:
        """(X'WX + S)^-1 with the intercept."""
        return self.inv if self.inv is not None else safe_inverse(self.h + self.penalty)

    @property
    def covariance(self) -> np.ndarray:
        return self.phi * self.inverse


def safe_inverse(m: np.ndarray) -> np.ndarray:
    """Inverse over the directions with eigenvalues above 1e-12 of the largest."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    keep = values > 1e-12 * max(values.max(), 1e-300)
    return (vectors[:, keep] / values[keep]) @ vectors[:, keep].T


def robust_solve(m: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Cholesky; if that fails or leaves a residual, the truncated inverse."""
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    try:
        low = np.linalg.cholesky(m / scale[:, None] / scale)
        x = np.linalg.solve(low.T, np.linalg.solve(low, r / scale)) / scale
        if np.isfinite(x).all() and np.abs(m @ x - r).max() <= 1e-6 * max(1.0, np.abs(r).max()):
            return x
    except np.linalg.LinAlgError:
        pass
    return safe_inverse(m) @ r


def padded(s: np.ndarray) -> np.ndarray:
    """A penalty with the intercept's zero row and column."""
    out = np.zeros((len(s) + 1,) * 2)
    out[1:, 1:] = s
    return out


def finish(fit: Fit, family: Family, edf: float | None = None) -> Fit:
    fit.edf = float(np.trace(fit.inverse @ fit.h)) if edf is None else edf
    fit.phi = 1.0 if family.scale_known else fit.pearson / max(fit.n - fit.edf, 1e-12)
    return fit


def start(source: Source, family: Family, link: Link, mean: float) -> np.ndarray:
    b = np.zeros(source.design.size + 1)
    b[0] = float(link.link(np.array(family.start(mean), float)))
    return b


def irls(source: Source, family: Family, link: Link, info: dict, s: np.ndarray, *, b=None, tol: float = 1e-8, max_iter: int = 100, convergence: str = "deviance", constraints: np.ndarray | None = None, step=None) -> Fit:
    """Newton steps on the penalised likelihood; halved (5 times at most) if the deviance more than doubles.

    `step(h, g, b)` replaces the linear solve, for group penalties.
    """
    penalty = padded(s)
    b = start(source, family, link, info["mean"]) if b is None else np.array(b, float)
    now = source.sums(b, family, link)
    trace, done, i = [], False, 0
    for i in range(1, max_iter + 1):
        m = now["h"] + penalty
        if step is not None:
            fresh = step(m, now["g"], b)
        elif constraints is not None and len(constraints):
            fresh = splines.solve_qp(m, now["g"], constraints, np.zeros(len(constraints)))
        else:
            fresh = robust_solve(m, now["g"])
        halvings, nxt = 0, source.sums(fresh, family, link)
        while halvings < 5 and (not np.isfinite(nxt["dev"]) or nxt["dev"] > 2 * abs(now["dev"]) + 1e-8):
            fresh = (fresh + b) / 2
            nxt = source.sums(fresh, family, link)
            halvings += 1
        change = abs(float(nxt["dev"] - now["dev"])) / (abs(float(nxt["dev"])) + 0.1) if convergence == "deviance" else np.abs(fresh - b).max() / (np.abs(fresh).max() + 0.1)
        b, now = fresh, nxt
        trace.append({"iteration": i, "deviance": float(now["dev"]), "w_max": float(now["top"]), "w_mean": float(now["h"][0, 0]) / max(info["n"], 1), "intercept": float(b[0]), "step_halvings": halvings, "change": float(change)})
        if change < tol:
            done = True
            break
    fit = Fit(b, float(now["dev"]), float(now["pearson"]), i, done, now["h"], penalty, info["n"], score=now["score"], trace=trace)
    return finish(fit, family)


# -- group penalties -------------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class GroupPenalty:
    """lambda1 times a penalty of group norms. kind: group_lasso, sparse_group_lasso, group_elastic_net or ridge."""

    kind: str = "group_lasso"
    lambda1: float | None = None
    alpha: float = 0.5
    features: tuple[str, ...] | None = None
    adaptive: tuple[float, float] | None = None  # exponent and epsilon of a second, reweighted stage

    def targets(self, name: str) -> bool:
        return self.features is None or name in self.features

    def prox(self, v: np.ndarray, step: float, weight: float, lam: float) -> np.ndarray:
        """argmin |x - v|^2 / (2 step) + lam * penalty(x) for one group."""

        def shrink(x, by):
            norm = np.linalg.norm(x)
            return x * max(0.0, 1 - by / norm) if norm > 0 else x

        if self.kind == "ridge":
            return v / (1 + step * lam)
        if self.kind == "sparse_group_lasso":
            soft = np.sign(v) * np.maximum(np.abs(v) - step * lam * self.alpha, 0)
            return shrink(soft, step * lam * (1 - self.alpha) * weight)
        if self.kind == "group_elastic_net":
            return shrink(v, step * lam * self.alpha * weight) / (1 + step * lam * (1 - self.alpha))
        return shrink(v, step * lam * weight)

    def value(self, x: np.ndarray, weight: float, lam: float) -> float:
        norm = float(np.linalg.norm(x))
        if self.kind == "ridge":
            return lam / 2 * norm**2
        if self.kind == "sparse_group_lasso":
            return lam * ((1 - self.alpha) * weight * norm + self.alpha * float(np.abs(x).sum()))
        if self.kind == "group_elastic_net":
            return lam * (self.alpha * weight * norm + (1 - self.alpha) / 2 * norm**2)
        return lam * weight * norm


def GroupLasso(lambda1=None, features=None, adaptive=None) -> GroupPenalty:
    return GroupPenalty("group_lasso", lambda1, 0.5, features and tuple(features), adaptive)


def SparseGroupLasso(lambda1=None, alpha=0.5, features=None, adaptive=None) -> GroupPenalty:
    return GroupPenalty("sparse_group_lasso", lambda1, alpha, features and tuple(features), adaptive)


def GroupElasticNet(lambda1=None, alpha=0.5, features=None, adaptive=None) -> GroupPenalty:
    return GroupPenalty("group_elastic_net", lambda1, alpha, features and tuple(features), adaptive)


def Ridge(lambda1=None, features=None) -> GroupPenalty:
    return GroupPenalty("ridge", lambda1, 0.5, features and tuple(features))


def Adaptive(expon: float = 1.0, eps: float = 1e-6) -> tuple[float, float]:
    return expon, eps


def group_weights(source: Source) -> dict[str, float]:
    return {n: math.sqrt(s.stop - s.start) for n, s in source.design.slices.items()}


def check_features(source: Source, penalty: GroupPenalty) -> None:
    if penalty.features and (strange := set(penalty.features) - set(source.design.slices)):
        raise ValueError(f"the penalty names unknown terms: {sorted(strange)}")


def lambda_max(source: Source, family: Family, link: Link, info: dict, penalty: GroupPenalty, weights: dict[str, float] | None = None) -> float:
    """The least lambda1 that leaves every targeted group at zero: one gradient at the mean."""
    weights = weights or group_weights(source)
    now = source.sums(start(source, family, link, info["mean"]), family, link)
    share = {"group_elastic_net": penalty.alpha, "sparse_group_lasso": 1 - penalty.alpha}.get(penalty.kind, 1.0)
    return max((float(np.linalg.norm(now["score"][1:][s])) / (weights[n] * info["n"] * max(share, 1e-12)) for n, s in source.design.slices.items() if penalty.targets(n)), default=0.0)


def block_descent(source: Source, family: Family, link: Link, info: dict, s: np.ndarray, penalty: GroupPenalty, lam: float, *, weights: dict[str, float] | None = None, b=None, tol: float = 1e-7, max_iter: int = 100, sweeps: int = 200) -> Fit:
    """Proximal Newton: each outer step minimises the quadratic model plus group penalty by block updates.

    The objective is the penalised log-likelihood over the number of rows, plus lam times the group penalty.
    """
    weights, n = weights or group_weights(source), info["n"]
    groups = [(name, slice(sl.start + 1, sl.stop + 1)) for name, sl in source.design.slices.items()]

    def step(m: np.ndarray, g: np.ndarray, b0: np.ndarray) -> np.ndarray:
        x = b0.copy()
        tops = {name: float(np.linalg.eigvalsh(m[sl, sl]).max()) / n + 1e-12 for name, sl in groups}
        for _ in range(sweeps):
            before = x.copy()
            x[0] += (g[0] - m[0] @ x) / m[0, 0]
            for name, sl in groups:
                for _ in range(3 if sl.stop - sl.start > 1 else 1):
                    slope = (m[sl] @ x - g[sl]) / n
                    v = x[sl] - slope / tops[name]
                    x[sl] = penalty.prox(v, 1 / tops[name], weights[name], lam) if penalty.targets(name) else v
            if np.abs(x - before).max() <= 0.01 * tol * (1 + np.abs(x).max()):
                break
        return x

    fit = irls(source, family, link, info, s, b=b, tol=tol, max_iter=max_iter, step=step)
    edf = 1.0
    for name, sl in groups:
        p, norm = sl.stop - sl.start, float(np.linalg.norm(fit.b[sl]))
        if norm > 0 or not penalty.targets(name):
            pull = lam * weights[name] / norm if penalty.targets(name) and penalty.kind != "ridge" else 0.0
            edf += p - (p - 1) * min(1.0, pull)
    if lam <= 0 or penalty.kind == "ridge":
        ridge = np.zeros_like(fit.h)
        for name, sl in groups:
            if penalty.kind == "ridge" and penalty.targets(name):
                ridge[sl, sl] = lam * n * np.eye(sl.stop - sl.start)
        fit.penalty = fit.penalty + ridge
        edf = None
    if penalty.adaptive and lam > 0 and weights == group_weights(source):
        expon, eps = penalty.adaptive
        flat = np.asarray(fit.h) / max(info["w"], 1e-300)
        fresh = {name: weights[name] / (math.sqrt(max(float(fit.b[sl] @ flat[sl, sl] @ fit.b[sl]), 0.0)) + eps) ** expon for name, sl in groups}
        return block_descent(source, family, link, info, s, penalty, lam, weights=fresh, b=fit.b, tol=tol, max_iter=max_iter, sweeps=sweeps)
    return finish(fit, family, edf)


def lambda_sequence(top: float, n_lambda: int = 50, ratio: float = 1e-3, given: Sequence[float] | None = None) -> list[float]:
    return sorted(map(float, given), reverse=True) if given is not None else np.geomspace(top, ratio * top, n_lambda).tolist()


def path(source: Source, family: Family, link: Link, info: dict, s: np.ndarray, penalty: GroupPenalty, lambdas: Sequence[float], **kw) -> list[Fit]:
    """Fits along a falling sequence, each from the one before."""
    out, b = [], None
    for lam in lambdas:
        fit = block_descent(source, family, link, info, s, penalty, lam, b=b, **kw)
        fit.lambdas = {"lambda1": float(lam)}
        out.append(fit)
        b = fit.b
    return out
