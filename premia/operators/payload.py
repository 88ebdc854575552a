"""What plots would show, as small DataFrames: effect curves with exposure, surfaces, diagnostics panels."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.functions import families, special
from premia.model import Model
from premia.operators import adequacy, charts
from premia.operators.terms import Spline
from premia.sources.scratch import written


def exposure_histogram(df: DataFrame, column: str, weight: str | None = None, n_bins: int = 200) -> DataFrame:
    """x (bin centre), weight over equal bins of the column's range."""
    binned = charts.discretised(df.select(F.col(f"`{column}`"), adequacy._w(weight).alias("__w")), column, n_bins)
    return binned.groupBy(F.col(f"`{column}_bin`").alias("x")).agg(F.sum("__w").alias("weight"))


def exposure_kde(df: DataFrame, column: str, weight: str | None = None, n_points: int = 200, width: float = 0.03, n_bins: int = 1000) -> DataFrame:
    """x, density: a Gaussian kernel estimate from a histogram of n_bins cells; width is a share of the range."""
    rows = exposure_histogram(df, column, weight, n_bins).orderBy("x").collect()
    x, w = np.array([r["x"] for r in rows]), np.array([r["weight"] for r in rows])
    span = (x[-1] - x[0]) or 1.0
    grid, h = np.linspace(x[0], x[-1], n_points), width * span
    d = (np.exp(-0.5 * ((grid[:, None] - x) / h) ** 2) * w).sum(axis=1) / (w.sum() * h * math.sqrt(2 * math.pi))
    return df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(grid, d, strict=True)], "x double, density double")


def kde_2d(df: DataFrame, a: str, b: str, weight: str | None = None, n_points: int = 40, width: float = 0.05, n_bins: int = 100) -> DataFrame:
    """x, y, density, and hdr_mass: the share of weight in places at least as dense."""
    cells = charts.discretised(charts.discretised(df.select(F.col(f"`{a}`"), F.col(f"`{b}`"), adequacy._w(weight).alias("__w")), a, n_bins), b, n_bins)
    rows = cells.groupBy(F.col(f"`{a}_bin`").alias("x"), F.col(f"`{b}_bin`").alias("y")).agg(F.sum("__w").alias("w")).orderBy("x", "y").collect()  # n_bins squared at most
    x, y, w = (np.array([r[k] for r in rows], float) for k in "xyw")
    gx, gy = np.linspace(x.min(), x.max(), n_points), np.linspace(y.min(), y.max(), n_points)
    kx = np.exp(-0.5 * ((gx[:, None] - x) / (width * (np.ptp(x) or 1))) ** 2)
    ky = np.exp(-0.5 * ((gy[:, None] - y) / (width * (np.ptp(y) or 1))) ** 2)
    d = (kx * w) @ ky.T
    d /= d.sum()
    order = np.argsort(d.ravel())[::-1]
    mass = np.empty(d.size)
    mass[order] = np.cumsum(d.ravel()[order])
    out = [(float(gx[i]), float(gy[j]), float(d[i, j]), float(mass[i * n_points + j])) for i in range(n_points) for j in range(n_points)]
    return df.sparkSession.createDataFrame(out, "x double, y double, density double, hdr_mass double")


def main_effect(model: Model, df: DataFrame, name: str, weight: str | None = None, n_points: int = 200, bases: bool = False, simultaneous: bool = False) -> dict[str, DataFrame]:
    """effect, and where they apply density, knots and bases."""
    spark = df.sparkSession
    out = {"effect": model.relativities(spark, name, n_points=n_points, simultaneous=simultaneous)}
    t = model.term(name)
    if isinstance(t, Spline):
        out["density"] = exposure_kde(df, t.column, weight, n_points)
    else:
        out["density"] = df.groupBy(F.col(f"`{t.columns[0]}`").cast("string").alias("x")).agg(F.sum(adequacy._w(weight)).alias("weight"))
    if isinstance(t, Spline):
        at = [t.lo, *t.interior(), t.hi]
        out["knots"] = spark.createDataFrame([(float(v), float(e)) for v, e in zip(at, t.curve(at, model.beta(name)), strict=True)], "x double, log_relativity double")
        if bases:
            grid = np.linspace(t.lo, t.hi, n_points)
            b = t.basis(grid)
            out["bases"] = spark.createDataFrame([(float(grid[i]), j, float(b[i, j])) for i in range(n_points) for j in range(b.shape[1]) if b[i, j]], "x double, basis int, value double")
    return out


def interaction(model: Model, df: DataFrame, name: str, weight: str | None = None, n_points: int = 30) -> dict[str, DataFrame]:
    """surface, and the density of two smooth parents."""
    t = model.term(name)
    out = {"surface": model.interaction_surface(df.sparkSession, name, n_points)}
    if isinstance(t.left, Spline) and isinstance(t.right, Spline):
        out["density"] = kde_2d(df, t.left.column, t.right.column, weight)
    return out


def compare_terms(models: dict[str, Model], name: str, spark, n_points: int = 200) -> DataFrame:
    """model, x or level, relativity of one term in several models."""
    rows = [(label, str(r["at"]), r["log_relativity"], r["relativity"]) for label, m in models.items() for r in m.term_curve(name, n_points)]
    return spark.createDataFrame(rows, "model string, at string, log_relativity double, relativity double")


def lowess(x, y, frac: float = 0.6, steps: int = 2) -> np.ndarray:
    """Robust local linear trend at the points themselves."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    n = len(x)
    k, robust, fit = max(2, math.ceil(frac * n)), np.ones(n), np.zeros(n)
    for _ in range(steps + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            h = max(np.partition(d, k - 1)[k - 1], 1e-12)
            w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3 * robust
            mx = (w * x).sum() / w.sum()
            my = (w * y).sum() / w.sum()
            v = (w * (x - mx) ** 2).sum()
            fit[i] = my + ((w * (x - mx) * (y - my)).sum() / v * (x[i] - mx) if v > 1e-12 else 0.0)
        r = np.abs(y - fit)
        s = 6 * np.median(r)
        robust = np.clip(1 - (r / s) ** 2, 0, 1) ** 2 if s > 0 else np.ones(n)
    return fit


def stratified_sample(df: DataFrame, mu: str, n: int, seed: int = 42, strata: int = 20) -> DataFrame:
    """About n rows, as many from each of the equal-count ranges of mu."""
    total = df.count()
    cuts = df.agg(F.percentile_approx(mu, [i / strata for i in range(1, strata)])).first()[0]
    at = charts.edge_bin(F.col(f"`{mu}`"), [-math.inf, *cuts, math.inf])
    return df.withColumn("__s", at).sampleBy("__s", {i: min(1.0, n / max(total, 1)) for i in range(strata)}, seed).drop("__s")


def diagnostic_panels(model: Model, df: DataFrame, y: str, weight: str | None = None, offset=None, n_sim: int = 100, max_points: int = 2000, seed: int = 42, ties: Sequence[str] = ()) -> dict[str, DataFrame]:
    """calibration, qq (quantile residuals with a simulated envelope), residuals (with a trend), leverage points.

    All rows count. Up to max_points rows are points of their own (n = 1); above that residuals are cells of a grid
    (means and n), leverage has the max_points rows of the largest Cook distance and cells for the others, and qq
    has max_points ranks of all rows, both ends included. Only the envelope and the trend come from a sample,
    stratified by the mean, of about max_points rows.
    """
    spark = df.sparkSession
    scored = model.predict(df, offset, "__mu")
    out = {"calibration": charts.calibration(scored, y, "__mu", weight, ties=ties)}
    every = adequacy.quantile_residuals(model.influence(df, y, weight, offset).withColumn("__mu", F.col("mu")), y, "__mu", model.family, weight, "qres", model.fit.phi, seed)
    every = written(every.select("__mu", "qres", "leverage", F.col("std_deviance_residual").alias("residual"), "cooks_distance", adequacy._w(weight).alias("__w")))
    total = every.count()
    many = total > max_points
    res = (stratified_sample(every, "__mu", max_points, seed) if many else every).toPandas()
    rng = np.random.default_rng(seed)
    mu, w = res["__mu"].to_numpy(), res["__w"].to_numpy()
    sims = []
    for _ in range(n_sim):
        draw = families.simulate(model.family, mu, model.fit.phi, w, rng)
        lo, hi = adequacy.cdf_bounds(model.family, draw, mu, w, model.fit.phi)
        sims.append(np.sort(special.norm_ppf(np.clip(lo + rng.random(len(lo)) * (hi - lo), 1e-10, 1 - 1e-10))))
    low, high = np.quantile(sims, [0.025, 0.975], axis=0)
    theory = special.norm_ppf((np.arange(len(res)) + 0.5) / len(res))
    observed, at = np.sort(res["qres"]), theory
    if many:
        ranks = np.unique(np.linspace(1, total, max_points).astype(np.int64))
        ranked = charts.running(every.select("qres"), [F.col("qres")], {"rank": F.lit(1.0)}).filter(F.col("rank").isin([float(r) for r in ranks]))
        observed, at = np.array([r["qres"] for r in ranked.orderBy("rank").select("qres").collect()]), special.norm_ppf((ranks - 0.5) / total)
    out["qq"] = spark.createDataFrame([tuple(map(float, r)) for r in zip(at, observed, np.interp(at, theory, low), np.interp(at, theory, high), strict=True)], "theoretical double, observed double, lower double, upper double")
    order = np.argsort(mu)
    trend = lowess(mu[order], res["residual"].to_numpy()[order]) if len(res) > 3 else np.zeros(len(res))
    points = (_cells(every, "__mu", "residual", ["__mu", "residual"]) if many else every.select("__mu", "residual", F.lit(1).cast("long").alias("n"))).orderBy("__mu").collect()
    out["residuals"] = spark.createDataFrame([(float(r["__mu"]), float(r["residual"]), float(np.interp(r["__mu"], mu[order], trend)), r["n"]) for r in points], "mu double, residual double, trend double, n long")
    names = ["leverage", "residual", "cooks_distance"]
    single = every.select(*names, F.lit(1).cast("long").alias("n"))
    if many:
        least = every.select("cooks_distance").orderBy(F.desc("cooks_distance")).limit(max_points).agg(F.min("cooks_distance")).first()[0]
        top = F.coalesce(F.col("cooks_distance") >= least, F.lit(False))
        single = single.filter(top).unionByName(_cells(every.filter(~top), "leverage", "residual", names))
    out["leverage"] = single
    return out


def _cells(df: DataFrame, a: str, b: str, means: Sequence[str], size: int = 80) -> DataFrame:
    """The means and the number n of the rows in each cell of a grid over the ranges of a and b."""
    lo_a, hi_a, lo_b, hi_b = df.agg(F.min(a), F.max(a), F.min(b), F.max(b)).first()
    if lo_a is None:
        return df.select(*means, F.lit(1).cast("long").alias("n"))
    place = [F.least(F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * size), F.lit(size - 1)).alias(k) for k, c, lo, hi in (("__i", a, lo_a, hi_a), ("__j", b, lo_b, hi_b))]
    return df.groupBy(*place).agg(*(F.avg(c).alias(c) for c in means), F.count("*").alias("n")).drop("__i", "__j")


def extreme_weights(model: Model, df: DataFrame, weight: str | None = None, offset=None, n: int = 5) -> DataFrame:
    """The n rows with the largest and the n with the smallest working weights."""
    eta = model.link.stabilise(model.eta(offset))
    d = model.link.deriv_inverse(eta)
    w: Column = adequacy._w(weight) * d * d / model.family.variance(model.family.clip(model.link.inverse(eta)))
    rows = df.withColumn("working_weight", w)
    top = rows.orderBy(F.desc("working_weight")).limit(n).withColumn("end", F.lit("top"))
    return top.unionByName(rows.orderBy("working_weight").limit(n).withColumn("end", F.lit("bottom")))


__all__ = ["compare_terms", "diagnostic_panels", "exposure_histogram", "exposure_kde", "extreme_weights", "interaction", "kde_2d", "lowess", "main_effect", "stratified_sample"]
