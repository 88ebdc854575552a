"""Fit statistics, residuals and adequacy tests as aggregates of a scored DataFrame."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions import special
from premia.functions.families import Family
from premia.functions.links import Link


def _w(weight: str | None) -> Column:
    return F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)


def fit_stats(df: DataFrame, y: str, mu: str, family: Family, weight: str | None = None, phi: float = 1.0, null_mu: Column | None = None) -> DataFrame:
    """n_obs, deviance, pearson_chi2, log_likelihood, null_deviance, null_log_likelihood, explained_deviance: one pass.

    Without an offset the null mean is the weighted mean. The Tweedie likelihood is summed by `log_likelihood`.
    """
    w, obs, m = _w(weight), F.col(f"`{y}`").cast("double"), F.col(f"`{mu}`").cast("double")
    if null_mu is None:
        mean = df.agg(F.sum(w * obs) / F.sum(w)).first()[0]
        null_mu = F.lit(float(mean))
    ll = lambda at: F.sum(family.log_likelihood(obs, at, w, phi)) if family.name != "tweedie" else F.lit(None).cast("double")
    out = df.agg(F.count("*").alias("n_obs"), F.sum(w * family.deviance(obs, m)).alias("deviance"), F.sum(w * (obs - m) * (obs - m) / family.variance(m)).alias("pearson_chi2"), ll(m).alias("log_likelihood"), F.sum(w * family.deviance(obs, null_mu)).alias("null_deviance"), ll(null_mu).alias("null_log_likelihood"))
    return out.withColumn("explained_deviance", 1 - F.col("deviance") / F.col("null_deviance"))


def log_likelihood(df: DataFrame, y: str, mu: str, family: Family, weight: str | None = None, phi: float = 1.0) -> float:
    """The log-likelihood of any family; the Tweedie density in Arrow batches."""
    w, obs, m = _w(weight), F.col(f"`{y}`").cast("double"), F.col(f"`{mu}`").cast("double")
    if family.name != "tweedie":
        return df.agg(F.sum(family.log_likelihood(obs, m, w, phi))).first()[0]
    p = family.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            a = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            total += float(special.tweedie_logpdf(a[0], a[1], phi, p, a[2]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], names=["t"])

    return df.select(obs.alias("y"), m.alias("m"), w.alias("w")).mapInArrow(run, "t double").agg(F.sum("t")).first()[0]


def profile_phi(df: DataFrame, y: str, mu: str, family: Family, weight: str | None, pearson: float, method: str = "pearson") -> tuple[float, float]:
    """(dispersion, negative log-likelihood): Pearson's as given, or (mle) the most likely within a factor of e^3 of it."""
    nll = lambda phi: -log_likelihood(df, y, mu, family, weight, phi)
    if method == "pearson":
        return pearson, nll(pearson)
    if method != "mle":
        raise ValueError("phi_method is pearson or mle")
    at, value, _ = special.minimise(lambda v: nll(math.exp(v)), math.log(pearson) - 3, math.log(pearson) + 3, 1e-4, 40)
    return math.exp(at), value


def information(ll: float, edf: float, n: int) -> dict[str, float]:
    """aic, bic, aicc."""
    aic = -2 * ll + 2 * edf
    left = n - edf - 1
    return {"aic": aic, "bic": -2 * ll + math.log(n) * edf, "aicc": aic + 2 * edf * (edf + 1) / left if left > 0 else math.inf}


def ebic(bic: float, active: int, groups: int, gamma: float = 0.5) -> float:
    """BIC plus 2 gamma times the log of the number of ways to choose the active groups."""
    return bic + 2 * gamma * (math.lgamma(groups + 1) - math.lgamma(active + 1) - math.lgamma(groups - active + 1))


def residuals(df: DataFrame, y: str, mu: str, family: Family, link: Link, kind: str = "deviance", weight: str | None = None, name: str = "residual", phi: float = 1.0, seed: int = 42) -> DataFrame:
    """df with deviance, pearson, response, working or quantile residuals."""
    w, obs, m = _w(weight), F.col(f"`{y}`").cast("double"), F.col(f"`{mu}`").cast("double")
    if kind == "quantile":
        return quantile_residuals(df, y, mu, family, weight, name, phi, seed)
    column = {
        "deviance": F.signum(obs - m) * F.sqrt(F.greatest(w * family.deviance(obs, m), F.lit(0.0))),
        "pearson": (obs - m) * F.sqrt(w / family.variance(m)),
        "response": obs - m,
        "working": (obs - m) * link.deriv(m),
    }
    if kind not in column:
        raise ValueError(f"unknown kind {kind!r}")
    return df.withColumn(name, column[kind])


def quantile_residuals(df: DataFrame, y: str, mu: str, family: Family, weight: str | None = None, name: str = "residual", phi: float = 1.0, seed: int = 42) -> DataFrame:
    """Randomised quantile residuals; the random part is a hash of the row's values and the seed."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{y}`"), F.col(f"`{mu}`"), *(F.col(f"`{c}`") for c in df.columns if not c.startswith("__"))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    given = df.withColumns({"__qy": F.col(f"`{y}`").cast("double"), "__qm": F.col(f"`{mu}`").cast("double"), "__qw": _w(weight), "__qu": uniform})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = {k: b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(float) for k in ("__qy", "__qm", "__qw", "__qu")}
            lo, hi = cdf_bounds(family, a["__qy"], a["__qm"], a["__qw"], phi)
            u = np.clip(lo + a["__qu"] * (hi - lo), 1e-10, 1 - 1e-10)
            keep = [i for i, n in enumerate(b.schema.names) if not n.startswith("__q")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(special.norm_ppf(u))], names=[*(b.schema.names[i] for i in keep), name])

    return given.mapInArrow(run, schema)


def with_cdf_bounds(df: DataFrame, y: str, mu: str, family: Family, weight: str | None = None, phi: float = 1.0) -> DataFrame:
    """df with cdf_below, P(Y < y), and cdf_upto, P(Y <= y), between which the randomised residuals are drawn."""
    given = df.withColumns({"__qy": F.col(f"`{y}`").cast("double"), "__qm": F.col(f"`{mu}`").cast("double"), "__qw": _w(weight)})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", cdf_below double, cdf_upto double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(float) for k in ("__qy", "__qm", "__qw")]
            keep = [i for i, n in enumerate(b.schema.names) if not n.startswith("__q")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array(x) for x in cdf_bounds(family, *a, phi))], names=[*(b.schema.names[i] for i in keep), "cdf_below", "cdf_upto"])

    return given.mapInArrow(run, schema)


def cdf_bounds(family: Family, y: np.ndarray, mu: np.ndarray, w: np.ndarray, phi: float) -> tuple[np.ndarray, np.ndarray]:
    """P(Y < y) and P(Y <= y); equal for continuous responses. Counts on the scale of w * y."""
    if family.name == "gaussian":
        u = special.norm_cdf((y - mu) * np.sqrt(w / phi))
        return u, u
    if family.name == "gamma":
        u = special.gammainc(w / phi, w / phi * y / mu)
        return u, u
    if family.name == "binomial":
        return np.where(y > 0, 1 - mu, 0.0), np.where(y > 0, 1.0, 1 - mu)
    if family.name == "tweedie":
        p, f = family.p, phi / w
        lam, alpha, scale = mu ** (2 - p) / (f * (2 - p)), (2 - p) / (p - 1), f * (p - 1) * mu ** (p - 1)
        out = np.exp(-lam)
        for j in range(1, int((lam + 6 * np.sqrt(lam) + 10).max(initial=0.0))):  # j claims, over all rows at once
            at = np.exp(j * np.log(lam) - lam - math.lgamma(j + 1))
            some = (y > 0) & (at > 1e-14)
            if some.any():
                out[some] += at[some] * special.gammainc(j * alpha, y[some] / scale[some])
        return np.where(y > 0, out, 0.0), out
    count, rate = np.round(y * w), mu * w
    if family.name == "poisson":
        cdf = lambda k: np.where(k >= 0, 1 - special.gammainc(np.maximum(k, 0) + 1, rate), 0.0)
    else:
        size = family.theta * w
        cdf = lambda k: np.where(k >= 0, special.betaincs(size, np.maximum(k, 0) + 1, size / (size + rate)), 0.0)
    return cdf(count - 1), cdf(count)


def zero_inflation(df: DataFrame, y: str, mu: str, family: Family) -> DataFrame:
    """observed_zeros, expected_zeros, zero_inflation_index ((observed - expected) / rows), ratio. Unweighted."""
    m = F.col(f"`{mu}`").cast("double")
    p0 = F.exp(-m) if family.name == "poisson" else F.pow(family.theta / (m + family.theta), F.lit(family.theta))
    g = df.agg(F.sum(F.when(F.col(f"`{y}`") == 0, 1.0).otherwise(0.0)).alias("observed_zeros"), F.sum(p0).alias("expected_zeros"), F.count("*").alias("n"))
    o, e = F.col("observed_zeros"), F.col("expected_zeros")
    return g.select("observed_zeros", "expected_zeros", ((o - e) / F.col("n")).alias("zero_inflation_index"), (o / e).alias("ratio"))


def score_test_zi(df: DataFrame, y: str, mu: str) -> DataFrame:
    """statistic, p_value (chi-square, one degree), direction: Poisson against zero-inflated Poisson."""
    m, obs = F.col(f"`{mu}`").cast("double"), F.col(f"`{y}`").cast("double")
    p0 = F.exp(-m)
    row = df.agg(F.sum((F.when(obs == 0, 1.0).otherwise(0.0) - p0) / p0).alias("u"), F.sum((1 - p0) / p0).alias("v"), F.sum(obs).alias("s")).first()
    stat = row["u"] ** 2 / (row["v"] - row["s"])
    return df.sparkSession.createDataFrame([(stat, special.chi2_sf(stat, 1), "inflated" if row["u"] > 0 else "deflated")], "statistic double, p_value double, direction string")


def dispersion_test(df: DataFrame, y: str, mu: str, alternative: str = "greater") -> DataFrame:
    """statistic, p_value, alpha_hat, alternative: auxiliary regression of ((y - mu)^2 - y) / mu on mu, no intercept."""
    m, obs = F.col(f"`{mu}`").cast("double"), F.col(f"`{y}`").cast("double")
    z = ((obs - m) * (obs - m) - obs) / m
    r = df.agg(F.sum(z * m).alias("zm"), F.sum(m * m).alias("mm"), F.sum(z * z).alias("zz"), F.count("*").alias("n")).first()
    a = r["zm"] / r["mm"]
    se = math.sqrt(max(r["zz"] - a * r["zm"], 1e-300) / (r["n"] - 1) / r["mm"])
    t = a / se
    p = {"greater": special.t_sf(t, r["n"] - 1), "less": special.t_sf(-t, r["n"] - 1), "two-sided": 2 * special.t_sf(abs(t), r["n"] - 1)}[alternative]
    return df.sparkSession.createDataFrame([(t, p, a, alternative)], "statistic double, p_value double, alpha_hat double, alternative string")


def vuong_test(df: DataFrame, ll_a: Column, ll_b: Column, edf_a: float, edf_b: float, correction: str = "aic") -> DataFrame:
    """statistic, p_value, preferred, correction, mean_diff, omega of two non-nested models' row log-likelihoods."""
    d = ll_a - ll_b
    r = df.agg(F.avg(d).alias("m"), F.var_pop(d).alias("v"), F.count("*").alias("n")).first()
    n, omega = r["n"], math.sqrt(r["v"])
    less = {"none": 0.0, "aic": edf_a - edf_b, "bic": (edf_a - edf_b) / 2 * math.log(n)}[correction]
    stat = (n * r["m"] - less) / (math.sqrt(n) * omega)
    p = float(2 * (1 - special.norm_cdf(abs(stat))))
    return df.sparkSession.createDataFrame([(stat, p, "a" if stat > 0 else "b", correction, r["m"], omega)], "statistic double, p_value double, preferred string, correction string, mean_diff double, omega double")


def root_of(gram: np.ndarray) -> np.ndarray:
    """R with R'R = gram, for a positive semi-definite matrix."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def fractional_wald(x: np.ndarray, cov: np.ndarray, rank: float) -> tuple[float, list[list[float]]]:
    """The statistic x' C x, C a pseudo-inverse of cov of fractional rank, and the weights of its chi-squares.

    With k whole directions and a rest r, the last whole one and the next (with eigenvalues l1 >= l2) are used together
    by a 2 x 2 block with 1 and r on its diagonal and sqrt(r (1 - r) / 2) beside it, which leaves the expectation at
    k + r and lets both directions take part. The sign beside the diagonal is arbitrary, so the statistic is the mean
    over both signs.
    """
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    most = int((values > 1e-10 * max(values[0], 1e-300)).sum()) if len(values) else 0
    if not most:
        return 0.0, [[1.0]]
    rank = min(rank, most)
    whole = int(math.floor(rank + 1e-9))
    rest = rank - whole if rank - whole > 1e-6 else 0.0
    z = vectors[:, :most].T @ x / np.sqrt(values[:most])
    if not rest:
        return float((z[:whole] ** 2).sum()), [[1.0] * whole]
    if not whole:  # one direction, used in part
        return float(rest * z[0] ** 2), [[rest]]
    alone, pair = z[: whole - 1], z[whole - 1 : whole + 1]
    off = math.sqrt(max(rest * (1 - rest) / 2, 0.0))
    blocks = [np.array([[1.0, sign * off], [sign * off, rest]]) for sign in (1, -1)]
    stat = float((alone**2).sum()) + float(np.mean([pair @ m @ pair for m in blocks]))
    return stat, [[1.0] * (whole - 1) + np.linalg.eigvalsh(m).tolist() for m in blocks]
