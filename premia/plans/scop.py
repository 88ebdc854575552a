"""Monotone smooths by shape-constrained splines: coefficients that are exponentials of free parameters.

A monotone term's columns are running sums of its B-splines, centred, so its curve is monotone just if the coefficients
are positive. They are written as exp(theta), and theta is penalised by its first differences; all other terms keep
their coefficients. Newton steps on the penalised likelihood of (coefficients, theta) need the same sums over the rows
as an unconstrained fit: with J the derivative of the coefficients by the parameters, the Hessian is J X'WX J + S less
the score's part on theta, and where that is not positive, without that part and with a small ridge.

Smoothing parameters come from Fellner-Schall steps on the Laplace criterion in the parameters, damped by whether a
step changes its sign.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

from premia.functions.families import Family
from premia.functions.links import Link
from premia.operators import splines
from premia.operators.frame import Source
from premia.plans.smoothing import LEAST, MOST, LogDet
from premia.plans.solve import Fit, padded, safe_inverse, start

LOWEST, HIGHEST = -16.0, 16.0  # of theta: a flat stretch has no finite one


def positive(source: Source) -> np.ndarray:
    """Which coefficients (intercept first) are exponentials."""
    out = np.zeros(source.design.size + 1, bool)
    for t in source.design.terms:
        if getattr(t, "scop", False):
            s = source.design.slices[t.name]
            out[s.start + 1 : s.stop + 1] = True
    return out


class Path:
    """Newton iterations at fixed smoothing parameters, started again from the last parameters."""

    def __init__(self, source: Source, family: Family, link: Link, info: dict):
        self.source, self.family, self.link, self.info, self.up = source, family, link, info, positive(source)
        b = start(source, family, link, info["mean"])
        b[self.up] = 1e-3
        now = source.sums(b, family, link)
        ridge = 1e-4 * np.trace(now["h"]) / len(b) * np.eye(len(b))
        first = splines.solve_qp(now["h"] + ridge, now["g"] + ridge @ b, np.eye(len(b))[self.up], np.zeros(int(self.up.sum())))
        self.theta = first.copy()
        self.theta[self.up] = np.log(np.maximum(first[self.up], 1e-3 * max(first[self.up].max(initial=0.0), 1e-6)))

    def coefficients(self, theta: np.ndarray) -> np.ndarray:
        return np.where(self.up, np.exp(np.clip(theta, LOWEST, HIGHEST)), theta)

    def at(self, theta: np.ndarray, s: np.ndarray) -> tuple[dict, float]:
        now = self.source.sums(self.coefficients(theta), self.family, self.link)
        return now, 0.5 * (float(now["dev"]) + float(theta @ s @ theta))

    def hessian(self, now: dict, s: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(Hessian by the parameters, J)."""
        j = np.where(self.up, b, 1.0)
        fisher = now["h"] * j[:, None] * j + s
        full = fisher - np.diag(np.where(self.up, j * now["score"], 0.0))
        try:
            np.linalg.cholesky(full + 1e-12 * np.trace(full) / len(full) * np.eye(len(full)))
            return full, j
        except np.linalg.LinAlgError:
            return fisher + 1e-8 * np.trace(fisher) / len(fisher) * np.eye(len(fisher)), j

    def solve(self, s: np.ndarray, tol: float, most: int) -> tuple[dict, np.ndarray, np.ndarray, int, bool]:
        """(sums, Hessian, J, iterations, converged) at the penalty s of the parameters."""
        now, value = self.at(self.theta, s)
        done, i = False, 0
        for i in range(1, most + 1):
            h, j = self.hessian(now, s, self.coefficients(self.theta))
            grad = j * now["score"] - s @ self.theta
            pinned = self.up & (((self.theta <= LOWEST) & (grad < 0)) | ((self.theta >= HIGHEST) & (grad > 0)))
            step = np.zeros(len(grad))
            step[~pinned] = safe_inverse(h[np.ix_(~pinned, ~pinned)]) @ grad[~pinned]
            step *= min(1.0, 4.0 / max(np.abs(step[self.up]).max(initial=0.0), 1e-300))
            for _ in range(11):
                theta = np.where(self.up, np.clip(self.theta + step, LOWEST, HIGHEST), self.theta + step)
                fresh, v = self.at(theta, s)
                if np.isfinite(v) and v <= value + 1e-12 * abs(value):
                    break
                step = step / 2
            else:
                done = True  # no descent left at working precision
                break
            change, self.theta, now, value = abs(value - v) / (abs(v) + 0.1), theta, fresh, v
            if change < tol:
                done = True
                break
        h, j = self.hessian(now, s, self.coefficients(self.theta))
        return now, h, j, i, done


def fit(source: Source, family: Family, link: Link, info: dict, named: Sequence[tuple[str, np.ndarray, object]], lams: Sequence[float], *, estimate: Sequence[int] = (), tol: float = 1e-9, max_iter: int = 100, rounds: int = 40, lam_tol: float = 1e-3) -> Fit:
    """The monotone fit; the parameters of the penalties listed in `estimate` are estimated, the others stay."""
    parts = [padded(p) for _, p, _ in named]
    lams, walk = np.array(lams, float), Path(source, family, link, info)
    live = [i for i in range(len(parts)) if lams[i] > 0]
    log_s = LogDet([parts[i][1:, 1:] for i in live])
    factor, last, trace, total, settled = np.ones(len(parts)), np.zeros(len(parts)), [], 0, not estimate
    for it in range(1, rounds + 1):
        s = sum((x * p for x, p in zip(lams, parts, strict=True)), np.zeros_like(parts[0]) if parts else np.zeros((source.design.size + 1,) * 2))
        now, h, j, n, done = walk.solve(s, tol, max_iter)
        total += n
        inv = safe_inverse(h)
        theta, dev = walk.theta, float(now["dev"])
        free = max(info["n"] - (len(theta) - log_s.rank), 1)
        phi = 1.0 if family.scale_known else (dev + float(theta @ s @ theta)) / free
        value = 0.5 * ((dev + float(theta @ s @ theta)) / phi + np.linalg.slogdet(h)[1] - log_s(lams[live])[0])
        trace.append({"iteration": it, "criterion": value, "stage": "monotone", "deviance": dev} | {named[i][0]: float(lams[i]) for i in range(len(parts))})
        if settled or not estimate:
            break
        share = dict(zip(live, log_s(lams[live])[1], strict=True))
        moves = np.zeros(len(parts))
        for i in estimate:
            gain, size = share[i] - lams[i] * float(np.trace(inv @ parts[i])), lams[i] * float(theta @ parts[i] @ theta)
            if gain > 0.05 * min(1.0, share[i]) or size > 0:
                moves[i] = math.log(max(phi * max(gain, 1e-8), 1e-300)) - math.log(max(size, 1e-12))
        factor = np.where(moves * last < 0, factor * 0.5, np.minimum(factor * 1.2, 2.0))
        last = moves
        before = np.log(np.maximum(lams, 1e-300))
        for i in estimate:
            lams[i] = float(np.clip(math.exp(before[i] + np.clip(factor[i] * moves[i], -4, 4)), LEAST, MOST))
        settled = all(abs(math.log(lams[i]) - before[i]) < lam_tol for i in estimate) or (it > 3 and abs(trace[-1]["criterion"] - trace[-2]["criterion"]) < 1e-8 * (1 + abs(value)))
    b = walk.coefficients(walk.theta)
    out = Fit(b, dev, float(now["pearson"]), total, done, now["h"], s, info["n"], score=now["score"], trace=trace if estimate else [], inv=inv * j[:, None] * j)
    out.edf = float(np.trace(out.inv @ out.h))
    out.phi = phi if not family.scale_known else 1.0
    if not estimate and not family.scale_known:
        out.phi = out.pearson / max(out.n - out.edf, 1e-12)
    out.lambdas = {n: float(x) for (n, _, _), x in zip(named, lams, strict=True)}
    return out
