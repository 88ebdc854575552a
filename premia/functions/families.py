"""Response families, each formula written once for NumPy arrays and for Spark columns.

`parts` splits the unit deviance into a(y) + y * b(mu) + c(mu), which lets a fit run on cell totals of y and a(y).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.functions import special
from premia.functions.links import ops


def _xlogy(x, y):
    o = ops(x)
    positive = o.where(x > 0, x, 1.0)
    return o.where(x > 0, x * o.log(o.where(x > 0, y, 1.0) * 1.0), positive * 0.0)


class Family:
    """V(mu), its derivatives, the unit deviance and the log-likelihood of one row."""

    name, default_link = "", "log"
    scale_known = False
    limits: tuple[float, float] | None = (1e-50, 1e50)
    #: The least response allowed, and whether it is allowed itself.
    least: tuple[float, bool] | None = None

    def variance(self, mu): ...
    def variance_derivative(self, mu): ...
    def variance_second_derivative(self, mu): ...
    def a(self, y): ...
    def b(self, mu): ...
    def c(self, mu): ...

    def deviance(self, y, mu):
        return self.a(y) + y * self.b(mu) + self.c(mu)

    def clip(self, mu):
        return mu if self.limits is None else ops(mu).clip(mu, *self.limits)

    def start(self, mean: float) -> float:
        return max(mean, 1e-12)

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        raise NotImplementedError

    def invalid(self, y: Column) -> Column:
        """Responses that the family does not allow."""
        bad = y.isNull() | F.isnan(y)
        if self.least is None:
            return bad
        low, itself = self.least
        return bad | ((y < low) if itself else (y <= low))


class Poisson(Family):
    name, scale_known, least = "poisson", True, (0.0, True)

    def variance(self, mu):
        return mu

    def variance_derivative(self, mu):
        return mu * 0.0 + 1.0

    def variance_second_derivative(self, mu):
        return mu * 0.0

    def a(self, y):
        return 2 * (_xlogy(y, y) - y)

    def b(self, mu):
        return -2 * ops(mu).log(mu)

    def c(self, mu):
        return 2 * mu

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        return w * (_xlogy(y, mu) - mu - _lgamma(y + 1))


class Gaussian(Family):
    name, default_link, limits = "gaussian", "identity", None

    def variance(self, mu):
        return mu * 0.0 + 1.0

    def variance_derivative(self, mu):
        return mu * 0.0

    variance_second_derivative = variance_derivative

    def a(self, y):
        return y * y

    def b(self, mu):
        return -2 * mu

    def c(self, mu):
        return mu * mu

    def start(self, mean: float) -> float:
        return mean

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        return -0.5 * (w * (y - mu) * (y - mu) / phi + math.log(2 * math.pi * phi) - ops(mu).log(w * 1.0))


class Gamma(Family):
    name, least = "gamma", (0.0, False)

    def variance(self, mu):
        return mu * mu

    def variance_derivative(self, mu):
        return 2 * mu

    def variance_second_derivative(self, mu):
        return mu * 0.0 + 2.0

    def a(self, y):
        return -2 * ops(y).log(y) - 2

    def b(self, mu):
        return 2 / mu

    def c(self, mu):
        return 2 * ops(mu).log(mu)

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        o, k = ops(mu), w / phi
        return k * o.log(k * y / mu) - k * y / mu - o.log(y) - _lgamma(k)


class Binomial(Family):
    name, default_link, scale_known, limits, least = "binomial", "logit", True, (1e-7, 1 - 1e-7), (0.0, True)

    def variance(self, mu):
        return mu * (1 - mu)

    def variance_derivative(self, mu):
        return 1 - 2 * mu

    def variance_second_derivative(self, mu):
        return mu * 0.0 - 2.0

    def a(self, y):
        return y * 0.0

    def b(self, mu):
        return -2 * ops(mu).log(mu / (1 - mu))

    def c(self, mu):
        return -2 * ops(mu).log(1 - mu)

    def start(self, mean: float) -> float:
        return min(max(mean, 1e-3), 1 - 1e-3)

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        return w * (y * ops(mu).log(mu) + (1 - y) * ops(mu).log(1 - mu))

    def invalid(self, y: Column) -> Column:
        return y.isNull() | ~y.isin(0.0, 1.0)


class NegativeBinomial(Family):
    """V = mu + mu^2 / theta. The unit deviance is non-negative, at y = 0 too."""

    name, scale_known, least = "negative_binomial", True, (0.0, True)

    def __init__(self, theta: float):
        if theta <= 0:
            raise ValueError("theta must be positive")
        self.theta = float(theta)

    def variance(self, mu):
        return mu + mu * mu / self.theta

    def variance_derivative(self, mu):
        return 1 + 2 * mu / self.theta

    def variance_second_derivative(self, mu):
        return mu * 0.0 + 2 / self.theta

    def a(self, y):
        return 2 * (_xlogy(y, y) - (y + self.theta) * ops(y).log(y + self.theta))

    def b(self, mu):
        return 2 * ops(mu).log((mu + self.theta) / mu)

    def c(self, mu):
        return 2 * self.theta * ops(mu).log(mu + self.theta)

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        t, o = self.theta, ops(mu)
        return w * (_lgamma(y + t) - _lgamma(y + 1) - math.lgamma(t) + t * math.log(t) + _xlogy(y, mu) - (y + t) * o.log(mu + t))


class Tweedie(Family):
    name, least = "tweedie", (0.0, True)

    def __init__(self, p: float):
        if not 1 < p < 2:
            raise ValueError("p must lie between 1 and 2")
        self.p = float(p)

    def variance(self, mu):
        return ops(mu).power(mu, self.p)

    def variance_derivative(self, mu):
        return self.p * ops(mu).power(mu, self.p - 1)

    def variance_second_derivative(self, mu):
        return self.p * (self.p - 1) * ops(mu).power(mu, self.p - 2)

    def a(self, y):
        return 2 * ops(y).power(y, 2 - self.p) / ((1 - self.p) * (2 - self.p))

    def b(self, mu):
        return -2 * ops(mu).power(mu, 1 - self.p) / (1 - self.p)

    def c(self, mu):
        return 2 * ops(mu).power(mu, 2 - self.p) / (2 - self.p)

    def log_likelihood(self, y, mu, w, phi: float = 1.0):
        if isinstance(mu, Column):
            raise TypeError("the Tweedie density is computed over arrays")
        return special.tweedie_logpdf(y, mu, phi, self.p, w)


def _lgamma(x):
    """log gamma. Over columns: Stirling's series after raising the argument by 8."""
    if not isinstance(x, Column):
        return special.gammaln(x)
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + float(i))
    z = x + 8.0
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3.0)) + 1 / (1260 * F.pow(z, 5.0)) - 1 / (1680 * F.pow(z, 7.0)) - F.log(shift)


def poisson() -> Family:
    return Poisson()


def gaussian() -> Family:
    return Gaussian()


def gamma() -> Family:
    return Gamma()


def binomial() -> Family:
    return Binomial()


def nb2(theta: float = 1.0) -> Family:
    return NegativeBinomial(theta)


def tweedie(p: float) -> Family:
    return Tweedie(p)


def resolve(family: str | Family) -> Family:
    if isinstance(family, Family):
        return family
    plain = {"poisson": Poisson, "gaussian": Gaussian, "gamma": Gamma, "binomial": Binomial}
    if family in plain:
        return plain[family]()
    raise ValueError(f"unknown family {family!r}; {', '.join(plain)}, or nb2(theta), tweedie(p)")


def simulate(family: Family, mu, phi: float, w, rng: np.random.Generator) -> np.ndarray:
    """One draw of each response; weights scale exposure or precision as in the likelihood."""
    mu, w = np.asarray(mu, float), np.broadcast_to(np.asarray(w, float), np.shape(mu))
    if family.name == "poisson":
        return rng.poisson(mu * w) / w
    if family.name == "gaussian":
        return rng.normal(mu, np.sqrt(phi / w))
    if family.name == "gamma":
        return rng.gamma(w / phi, mu * phi / w)
    if family.name == "binomial":
        return (rng.random(mu.shape) < mu).astype(float)
    if family.name == "negative_binomial":
        size = family.theta * w
        return rng.poisson(rng.gamma(size, mu * w / size)) / w
    p, f = family.p, phi / w
    claims = rng.poisson(mu ** (2 - p) / (f * (2 - p)))
    alpha = (2 - p) / (p - 1)
    return np.where(claims > 0, rng.gamma(np.maximum(claims, 1) * alpha, f * (p - 1) * mu ** (p - 1)), 0.0)
