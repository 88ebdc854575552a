"""Link functions, each formula written once for NumPy arrays and for Spark columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from premia.functions import special


class _Arrays:
    """The few functions that the formulas need, over arrays."""

    log, exp, sqrt, tan, atan, abs = np.log, np.exp, np.sqrt, np.tan, np.arctan, np.abs
    log1p, expm1 = np.log1p, np.expm1
    power = staticmethod(np.power)
    clip = staticmethod(lambda x, lo, hi: np.clip(x, lo, hi))
    where = staticmethod(lambda cond, a, b: np.where(cond, a, b))


class _Columns:
    """The same over columns."""

    log, exp, sqrt, tan, atan, abs = F.log, F.exp, F.sqrt, F.tan, F.atan, F.abs
    log1p, expm1 = F.log1p, F.expm1
    power = staticmethod(F.pow)
    clip = staticmethod(lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))
    where = staticmethod(lambda cond, a, b: F.when(cond, a).otherwise(b))


def ops(x):
    return _Columns if isinstance(x, Column) else _Arrays


class Link:
    """eta = link(mu). `bounds` limits eta before it is inverted."""

    name = ""
    bounds: tuple[float, float] | None = (-20.0, 20.0)

    def link(self, mu): ...
    def inverse(self, eta): ...

    def deriv_inverse(self, eta):
        """d mu / d eta"""
        raise NotImplementedError

    def deriv(self, mu):
        """d eta / d mu"""
        return 1 / self.deriv_inverse(self.link(mu))

    def deriv2_inverse(self, eta):
        h = 1e-4
        return (self.deriv_inverse(eta + h) - self.deriv_inverse(eta - h)) / (2 * h)

    def deriv3_inverse(self, eta):
        h = 1e-3
        return (self.deriv_inverse(eta + h) - 2 * self.deriv_inverse(eta) + self.deriv_inverse(eta - h)) / (h * h)

    def stabilise(self, eta):
        return eta if self.bounds is None else ops(eta).clip(eta, *self.bounds)


class Log(Link):
    name, bounds = "log", (-80.0, 80.0)

    def link(self, mu):
        return ops(mu).log(mu)

    def inverse(self, eta):
        return ops(eta).exp(eta)

    deriv_inverse = deriv2_inverse = deriv3_inverse = inverse

    def deriv(self, mu):
        return 1 / mu


class Identity(Link):
    name, bounds = "identity", None

    def link(self, mu):
        return mu

    def inverse(self, eta):
        return eta

    def deriv_inverse(self, eta):
        return eta * 0.0 + 1.0

    def deriv(self, mu):
        return mu * 0.0 + 1.0

    def deriv2_inverse(self, eta):
        return eta * 0.0

    deriv3_inverse = deriv2_inverse


class Logit(Link):
    name = "logit"

    def link(self, mu):
        return ops(mu).log(mu / (1 - mu))

    def inverse(self, eta):
        return 1 / (1 + ops(eta).exp(-eta))

    def deriv(self, mu):
        return 1 / (mu * (1 - mu))

    def deriv_inverse(self, eta):
        m = self.inverse(eta)
        return m * (1 - m)

    def deriv2_inverse(self, eta):
        m = self.inverse(eta)
        return m * (1 - m) * (1 - 2 * m)

    def deriv3_inverse(self, eta):
        m = self.inverse(eta)
        return m * (1 - m) * (1 - 6 * m + 6 * m * m)


class Probit(Link):
    """Over columns the normal distribution function is Spark's erf-free rational form; fits use the arrays."""

    name = "probit"

    def link(self, mu):
        if isinstance(mu, Column):
            raise TypeError("the probit of a column is not available; score with inverse")
        return special.norm_ppf(mu)

    def inverse(self, eta):
        if not isinstance(eta, Column):
            return special.norm_cdf(eta)
        # |error| < 7.5e-8 (Abramowitz and Stegun 26.2.17)
        x = F.abs(eta)
        t = 1 / (1 + 0.2316419 * x)
        series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series
        return F.when(eta >= 0, 1 - tail).otherwise(tail)

    def deriv_inverse(self, eta):
        return ops(eta).exp(-eta * eta / 2) / math.sqrt(2 * math.pi)

    def deriv2_inverse(self, eta):
        return -eta * self.deriv_inverse(eta)

    def deriv3_inverse(self, eta):
        return (eta * eta - 1) * self.deriv_inverse(eta)


class Cloglog(Link):
    name = "cloglog"

    def link(self, mu):
        return ops(mu).log(-ops(mu).log1p(-mu))

    def inverse(self, eta):
        return -ops(eta).expm1(-ops(eta).exp(eta))

    def deriv_inverse(self, eta):
        e = ops(eta).exp(eta)
        return e * ops(eta).exp(-e)

    def deriv2_inverse(self, eta):
        e = ops(eta).exp(eta)
        return (1 - e) * e * ops(eta).exp(-e)

    def deriv3_inverse(self, eta):
        e = ops(eta).exp(eta)
        return (1 - 3 * e + e * e) * e * ops(eta).exp(-e)


class Cauchit(Link):
    name = "cauchit"

    def link(self, mu):
        return ops(mu).tan(math.pi * (mu - 0.5))

    def inverse(self, eta):
        return 0.5 + ops(eta).atan(eta) / math.pi

    def deriv_inverse(self, eta):
        return 1 / (math.pi * (1 + eta * eta))

    def deriv2_inverse(self, eta):
        return -2 * eta / (math.pi * (1 + eta * eta) * (1 + eta * eta))

    def deriv3_inverse(self, eta):
        d = 1 + eta * eta
        return (6 * eta * eta - 2) / (math.pi * d * d * d)


class Power(Link):
    """eta = mu ** power."""

    def __init__(self, power: float = 1.0):
        if power == 0:
            raise ValueError("power 0 is the log link")
        self.power, self.name = float(power), f"power({power:g})"
        self.bounds = None if power == 1 else (1e-12, 1e12)

    def link(self, mu):
        return ops(mu).power(mu, self.power)

    def _term(self, eta, k: int):
        q, c = 1 / self.power, 1.0
        for i in range(k):
            c *= q - i
        return c * ops(eta).power(eta, q - k)

    def inverse(self, eta):
        return self._term(eta, 0)

    def deriv(self, mu):
        return self.power * ops(mu).power(mu, self.power - 1)

    def deriv_inverse(self, eta):
        return self._term(eta, 1)

    def deriv2_inverse(self, eta):
        return self._term(eta, 2)

    def deriv3_inverse(self, eta):
        return self._term(eta, 3)


class Inverse(Power):
    def __init__(self):
        super().__init__(-1.0)
        self.name = "inverse"


class InverseSquared(Power):
    def __init__(self):
        super().__init__(-2.0)
        self.name = "inverse_squared"


class Sqrt(Power):
    def __init__(self):
        super().__init__(0.5)
        self.name, self.bounds = "sqrt", (-20.0, 20.0)

    def inverse(self, eta):
        return eta * eta

    def deriv_inverse(self, eta):
        return 2 * eta

    def deriv2_inverse(self, eta):
        return eta * 0.0 + 2.0

    def deriv3_inverse(self, eta):
        return eta * 0.0


class NegativeBinomialLink(Link):
    """eta = log(mu / (mu + theta))."""

    bounds = (-30.0, -1e-10)

    def __init__(self, theta: float = 1.0):
        if theta <= 0:
            raise ValueError("theta must be positive")
        self.theta, self.name = float(theta), f"nb({theta:g})"

    def link(self, mu):
        return ops(mu).log(mu / (mu + self.theta))

    def inverse(self, eta):
        e = ops(eta).exp(eta)
        return self.theta * e / (1 - e)

    def deriv(self, mu):
        return self.theta / (mu * (mu + self.theta))

    def deriv_inverse(self, eta):
        e = ops(eta).exp(eta)
        return self.theta * e / ((1 - e) * (1 - e))

    def deriv2_inverse(self, eta):
        e = ops(eta).exp(eta)
        return self.theta * e * (1 + e) / ((1 - e) * (1 - e) * (1 - e))

    def deriv3_inverse(self, eta):
        e = ops(eta).exp(eta)
        d = 1 - e
        return self.theta * e * (1 + 4 * e + e * e) / (d * d * d * d)


NAMED = {c.name: c for c in (Log, Identity, Logit, Probit, Cloglog, Cauchit)} | {"inverse": Inverse, "inverse_squared": InverseSquared, "sqrt": Sqrt, "power": Power, "nb": NegativeBinomialLink}


def resolve(link: str | Link | None, family) -> Link:
    """A link from its name; None is the family's own."""
    if link is None:
        return NAMED[family.default_link]()
    if isinstance(link, Link):
        return link
    if link not in NAMED:
        raise ValueError(f"unknown link {link!r}; one of {', '.join(sorted(NAMED))}")
    return NAMED[link]()
