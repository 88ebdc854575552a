"""Models: what to fit (`Glm`), and what was fitted (`Model`, which never changes)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions import families, links, special
from premia.functions.families import Family
from premia.functions.links import Link
from premia.operators import adequacy, charts, splines
from premia.operators.frame import Design, Frame, build, irls_weights
from premia.operators.terms import Categorical, Interaction, LambdaPolicy, Numeric, OrderedCategorical, Polynomial, Spline, Term, detect
from premia.plans import scop, smoothing, solve
from premia.plans.solve import Fit, GroupPenalty


@dataclass(frozen=True)
class Glm:
    """A model to fit: family, link, terms, penalties and solver settings."""

    family: str | Family = "poisson"
    terms: tuple[Term, ...] = ()
    link: str | Link | None = None
    penalty: GroupPenalty | None = None
    spline_penalty: float = 0.1
    tol: float = 1e-8
    max_iter: int = 100
    convergence: str = "deviance"

    def __post_init__(self):
        object.__setattr__(self, "family", families.resolve(self.family))
        object.__setattr__(self, "link", links.resolve(self.link, self.family))
        object.__setattr__(self, "terms", tuple(self.terms))
        if self.convergence not in ("deviance", "coefficients"):
            raise ValueError("convergence is by deviance or coefficients")
        names = [t.name for t in self.terms]
        if len(set(names)) < len(names):
            raise ValueError("two terms have one name")

    @staticmethod
    def detected(df: DataFrame, y: str, *, splines_of: Sequence[str] = (), n_knots: int | Sequence[int] = 10, skip: Sequence[str] = (), **kw) -> Glm:
        """Terms from the column types of df."""
        return Glm(terms=tuple(detect(df, splines_of, n_knots, [y, *skip])), **kw)

    def without(self, names: Sequence[str]) -> Glm:
        """Without some terms and every interaction of theirs."""
        gone = set(names)
        keep = tuple(t for t in self.terms if t.name not in gone and not (isinstance(t, Interaction) and {t.left.name, t.right.name} & gone))
        return replace(self, terms=keep)

    @contextmanager
    def _ready(self, df: DataFrame, y: str, weight, offset):
        """(frame, info, source, terms) with the columns of the fit kept in memory for the length of a block."""
        columns = [c for t in self.terms for c in t.columns]
        frame = Frame.of(df, y, weight, offset, columns)
        frame.df.persist()  # several aggregations read the same few columns
        try:
            info = frame.check(self.family)
            source, terms = build(frame, self.terms, self.family, info["n"], self.spline_penalty)
            yield frame, info, source, terms
        finally:
            frame.df.unpersist()

    def _monotone(self, source) -> bool:
        """Is there a monotone smooth by exponentials? It allows no other constraint and no group penalty beside it."""
        found = any(getattr(t, "scop", False) for t in source.design.terms)
        if found and (self.penalty is not None or self._constraints(source) is not None):
            raise ValueError("a monotone smooth of kind ps or bs goes with neither a group penalty nor another constraint")
        return found

    def _constraints(self, source) -> np.ndarray | None:
        rows = []
        for t in source.design.terms:
            if isinstance(t, Spline) and t.constraint and t.constraint.mode == "fit" and not t.scop:
                a = splines.monotone_rows(t.raw_size, t.constraint.kind)
                out = np.zeros((len(a), source.design.size + 1))
                s = source.design.slices[t.name]
                out[:, s.start + 1 : s.stop + 1] = a @ t.transform
                rows.append(out)
        return np.vstack(rows) if rows else None

    def _fixed(self, source) -> tuple[np.ndarray, dict[str, float]]:
        s, lams = np.zeros((source.design.size,) * 2), {}
        for name, p, policy in source.design.penalties():
            lam = policy.value if policy.mode != "estimate" else self.spline_penalty
            s += lam * p
            lams[name] = lam
        return s, lams

    def _model(self, fit: Fit, source, terms, info, frame: Frame) -> Model:
        return Model(replace(self, terms=tuple(terms)), source.design, fit, info, frame.has_offset)

    def fit(self, df: DataFrame, y: str, weight: str | None = None, offset: str | Sequence[str] | None = None) -> Model:
        """Fixed penalties: IRLS, or block descent if there is a group penalty (lambda1 None: a tenth of the largest)."""
        with self._ready(df, y, weight, offset) as (frame, info, source, terms):
            return self._fitted(frame, info, source, terms)

    def _fitted(self, frame, info, source, terms) -> Model:
        s, lams = self._fixed(source)
        if self._monotone(source):
            named = source.design.penalties()
            fit = scop.fit(source, self.family, self.link, info, named, [lams[n] for n, _, _ in named], tol=min(self.tol, 1e-9), max_iter=self.max_iter)
        elif self.penalty is None:
            fit = solve.irls(source, self.family, self.link, info, s, tol=self.tol, max_iter=self.max_iter, convergence=self.convergence, constraints=self._constraints(source))
        else:
            solve.check_features(source, self.penalty)
            lam = self.penalty.lambda1
            if lam is None:
                lam = 0.1 * solve.lambda_max(source, self.family, self.link, info, self.penalty)
            fit = solve.block_descent(source, self.family, self.link, info, s, self.penalty, lam, tol=max(self.tol, 1e-10), max_iter=self.max_iter)
            lams = lams | {"lambda1": lam}
        fit.lambdas = lams
        return self._model(fit, source, terms, info, frame)

    def fit_reml(self, df: DataFrame, y: str, weight: str | None = None, offset: str | Sequence[str] | None = None, *, max_reml_iter: int = 60, reml_tol: float = 1e-5) -> Model:
        """Smoothing parameters by restricted likelihood. Group penalties with a lambda1 above 0 are not allowed."""
        if self.penalty is not None and self.penalty.lambda1:
            raise ValueError("fit_reml needs lambda1 = 0")
        with self._ready(df, y, weight, offset) as (frame, info, source, terms):
            named = source.design.penalties()
            if self._monotone(source):
                first = [p.value if p.mode != "estimate" else 1.0 for _, _, p in named]
                fit = scop.fit(source, self.family, self.link, info, named, first, estimate=[i for i, (_, _, p) in enumerate(named) if p.mode == "estimate"])
            else:
                fit = smoothing.smooth(source, self.family, self.link, info, named, tol=reml_tol, max_iter=max_reml_iter, pirls_tol=self.tol, constraints=self._constraints(source))
            return self._model(fit, source, terms, info, frame)

    def lambda_max(self, df: DataFrame, y: str, weight=None, offset=None) -> float:
        with self._ready(df, y, weight, offset) as (_, info, source, _):
            return solve.lambda_max(source, self.family, self.link, info, self.penalty or solve.GroupLasso())

    def fit_path(self, df: DataFrame, y: str, weight=None, offset=None, *, n_lambda: int = 50, lambda_ratio: float = 1e-3, lambda_seq: Sequence[float] | None = None) -> DataFrame:
        """lambda, deviance, edf, n_iter, converged, intercept, beta along a falling sequence of group penalties."""
        with self._ready(df, y, weight, offset) as (_, info, source, _):
            penalty = self.penalty or solve.GroupLasso()
            solve.check_features(source, penalty)
            s, _ = self._fixed(source)
            top = solve.lambda_max(source, self.family, self.link, info, penalty)
            fits = solve.path(source, self.family, self.link, info, s, penalty, solve.lambda_sequence(top, n_lambda, lambda_ratio, lambda_seq), tol=max(self.tol, 1e-9), max_iter=self.max_iter)
        rows = [(f.lambdas["lambda1"], f.deviance, f.edf, f.n_iter, f.converged, f.intercept, f.beta.tolist()) for f in fits]
        return df.sparkSession.createDataFrame(rows, "`lambda` double, deviance double, edf double, n_iter int, converged boolean, intercept double, beta array<double>")

    def estimate_theta(self, df: DataFrame, y: str, weight=None, offset=None, *, bounds: tuple[float, float] = (0.1, 50.0), tol: float = 1e-3, most: int = 30) -> tuple[Model, Profile]:
        """Negative binomial: fit at theta, Newton for theta at the fitted means, again until it stays."""
        theta, model, n = 1.0, None, 0
        for n in range(1, most + 1):
            model = replace(self, family=families.nb2(theta)).fit(df, y, weight, offset)
            fresh = _theta_at(model, df, y, weight, offset, theta, bounds)
            done = abs(fresh - theta) < tol * max(1.0, theta)
            theta = fresh
            if done:
                break
        model = replace(self, family=families.nb2(theta)).fit(df, y, weight, offset)
        nll = -adequacy.log_likelihood(model.predict(df, offset=offset, name="__mu"), y, "__mu", model.family, weight)
        return model, Profile("theta", theta, nll, n, n < most, tuple())

    def profile_interval(self, df: DataFrame, y: str, profile: Profile, weight=None, offset=None, *, bounds: tuple[float, float] | None = None, alpha: float = 0.05) -> tuple[float, float]:
        """The profile likelihood interval of theta or of the Tweedie power: the model is refitted at each value tried."""
        make = families.nb2 if profile.parameter == "theta" else families.tweedie
        seen: dict[float, float] = {profile.value: profile.nll}

        def nll(v: float) -> float:
            if v not in seen:
                model = replace(self, family=make(v)).fit(df, y, weight, offset)
                scored = model.predict(df, offset=offset, name="__mu")
                seen[v] = -adequacy.log_likelihood(scored, y, "__mu", model.family, weight, 1.0 if profile.parameter == "theta" else model.fit.phi)
            return seen[v]

        return profile.ci(nll, bounds or ((0.1, 50.0) if profile.parameter == "theta" else (1.05, 1.95)), alpha)

    def estimate_p(self, df: DataFrame, y: str, weight=None, offset=None, *, bounds: tuple[float, float] = (1.05, 1.95), tol: float = 1e-3, method: str = "brent", grid: int = 10, fit_mode: str = "fit", phi_method: str = "pearson") -> tuple[Model, Profile]:
        """Tweedie power by profile likelihood: brent, grid, or grid_refine (a grid, then brent around its best).

        The dispersion at each power is Pearson's, or (phi_method mle) the most likely one at the fitted means.
        """
        trace: list[dict] = []

        def at(p: float) -> float:
            g = replace(self, family=families.tweedie(p))
            model = g.fit_reml(df, y, weight, offset) if fit_mode == "reml" else g.fit(df, y, weight, offset)
            scored = model.predict(df, offset=offset, name="__mu")
            phi, nll = adequacy.profile_phi(scored, y, "__mu", model.family, weight, model.fit.phi, phi_method)
            trace.append({"step": len(trace) + 1, "p": p, "phi": phi, "nll": nll, "n_iter": model.fit.n_iter, "fit_converged": model.fit.converged, "source": method})
            return nll

        lo, hi = bounds
        if method in ("grid", "grid_refine"):
            points = np.linspace(lo, hi, grid)
            values = [at(float(p)) for p in points]
            i = int(np.argmin(values))
            best = float(points[i])
            lo, hi = float(points[max(0, i - 1)]), float(points[min(grid - 1, i + 1)])
        if method in ("brent", "grid_refine"):
            best, _, _ = special.minimise(at, lo, hi, tol, 30)
        elif method != "grid":
            raise ValueError("method is brent, grid or grid_refine")
        g = replace(self, family=families.tweedie(best))
        model = g.fit_reml(df, y, weight, offset) if fit_mode == "reml" else g.fit(df, y, weight, offset)
        return model, Profile("p", best, min(t["nll"] for t in trace), len(trace), True, tuple(trace))


def _theta_at(model: Model, df: DataFrame, y: str, weight, offset, theta: float, bounds) -> float:
    """Newton on theta at fixed means: the digamma sums need one Arrow pass for each step."""
    scored = model.predict(df, offset=offset, name="__mu").select(F.col(f"`{y}`").cast("double").alias("y"), F.col("__mu").alias("m"), adequacy._w(weight).alias("w")).groupBy("y", "m").agg(F.sum("w").alias("w"))
    scored = scored.persist()
    for _ in range(10):
        now = theta

        def run(batches: Iterator[pa.RecordBatch], t=now) -> Iterator[pa.RecordBatch]:
            g = h = 0.0
            for b in batches:
                if b.num_rows:
                    yy, m, w = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                    g += float((w * (special.digamma(yy + t) - special.digamma(t) + math.log(t) + 1 - np.log(m + t) - (yy + t) / (m + t))).sum())
                    h += float((w * (special.trigamma(yy + t) - special.trigamma(t) + 1 / t - 2 / (m + t) + (yy + t) / (m + t) ** 2)).sum())
            yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([h])], names=["g", "h"])

        row = scored.mapInArrow(run, "g double, h double").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
        step = row["g"] / abs(row["h"]) if row["h"] else 0.0
        theta = min(max(now + step, now / 4, bounds[0]), now * 4, bounds[1])
        if abs(theta - now) < 1e-6 * now:
            break
    scored.unpersist()
    return theta


@dataclass(frozen=True)
class Profile:
    """A profiled family parameter."""

    parameter: str
    value: float
    nll: float
    n_evaluations: int
    converged: bool
    trace: tuple[dict, ...]

    def ci(self, objective, bounds: tuple[float, float], alpha: float = 0.05) -> tuple[float, float]:
        """Where the negative log-likelihood is half a chi-square quantile above its least."""
        cut = float(special.norm_ppf(1 - alpha / 2)) ** 2 / 2 + self.nll
        lo = bounds[0] if objective(bounds[0]) < cut else special.bisect(lambda v: objective(v) - cut, bounds[0], self.value, 1e-6)
        hi = bounds[1] if objective(bounds[1]) < cut else special.bisect(lambda v: objective(v) - cut, self.value, bounds[1], 1e-6)
        return lo, hi


@dataclass(frozen=True)
class Model:
    """A fitted model: scores any DataFrame, batch or streaming, with one generated column."""

    spec: Glm
    design: Design
    fit: Fit
    info: dict = field(default_factory=dict)
    has_offset: bool = False

    @property
    def family(self) -> Family:
        return self.spec.family

    @property
    def link(self) -> Link:
        return self.spec.link

    def term(self, name: str) -> Term:
        for t in self.design.terms:
            if t.name == name:
                return t
        raise KeyError(name)

    def beta(self, name: str) -> np.ndarray:
        return self.fit.beta[self.design.slices[name]]

    # -- scoring ---------------------------------------------------------------------------------------------------
    def eta(self, offset: str | Sequence[str] | None = None) -> Column:
        out = F.lit(self.fit.intercept) + self.design.effect(self.fit.beta)
        for c in [offset] if isinstance(offset, str) else list(offset or []):
            out = out + F.col(f"`{c}`").cast("double")
        return out

    def mean(self, offset=None) -> Column:
        return self.family.clip(self.link.inverse(self.link.stabilise(self.eta(offset))))

    def predict(self, df: DataFrame, offset=None, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.mean(offset))

    def contributions(self, df: DataFrame, prefix: str = "term_") -> DataFrame:
        """One column for each term's part of the linear predictor."""
        return df.withColumns({f"{prefix}{t.name}": t.effect(self.beta(t.name)) for t in self.design.terms})

    # -- tables of the fit -----------------------------------------------------------------------------------------
    def _frame(self, spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
        return spark.createDataFrame(rows, schema)

    def group_edf(self) -> dict[str, float]:
        f = self.fit.inverse @ self.fit.h
        return {n: float(np.trace(f[s.start + 1 : s.stop + 1, s.start + 1 : s.stop + 1])) for n, s in self.design.slices.items()}

    def coefficients(self, spark: SparkSession, alpha: float = 0.05) -> DataFrame:
        """term, idx, value, se, statistic, p_value, ci_lower, ci_upper; z or t by whether the scale is known."""
        se = np.sqrt(np.maximum(np.diag(self.fit.covariance), 0))
        z = float(special.norm_ppf(1 - alpha / 2))
        df = max(self.fit.n - self.fit.edf, 1)
        names = [("(intercept)", 0)] + [(t.name, i) for t in self.design.terms for i in range(t.size)]
        rows = []
        for (name, i), b, s in zip(names, self.fit.b.tolist(), se.tolist(), strict=True):
            stat = b / s if s > 0 else math.nan
            p = 2 * (1 - float(special.norm_cdf(abs(stat)))) if self.family.scale_known else 2 * special.t_sf(abs(stat), df)
            rows.append((name, i, b, s, stat, p, b - z * s, b + z * s))
        return self._frame(spark, rows, "term string, idx int, value double, se double, statistic double, p_value double, ci_lower double, ci_upper double")

    def term_curve(self, name: str, n_points: int = 200, alpha: float = 0.05, centering: str = "native", simultaneous: bool = False, n_sim: int = 10_000, seed: int = 42) -> list[dict]:
        """Points or levels of a main effect with relativity, standard error and intervals."""
        t, b = self.term(name), self.beta(name)
        cov = self.fit.covariance[1:, 1:][self.design.slices[name], self.design.slices[name]]
        if isinstance(t, Categorical):
            at, x = list(t.levels), np.vstack([np.zeros(t.size) if v == t.base_level else np.eye(t.size)[t.others.index(v)] for v in t.levels])
        elif isinstance(t, OrderedCategorical):
            at = [v for v in t.ranked if t.inner or v in t.steps.levels]
            x = t.design({t.column: np.array(at, object)})
        elif isinstance(t, Spline):
            grid = np.linspace(t.lo, t.hi, n_points)
            at, x = grid.tolist(), t.design({t.column: grid})
        elif isinstance(t, Polynomial):
            grid = np.linspace(t.lo, t.hi, n_points)
            at, x = grid.tolist(), t.raw({t.column: grid})
        elif isinstance(t, Numeric):
            at, x = [1.0], np.ones((1, 1))
        else:
            raise TypeError("curves are for main effects")
        if centering == "mean" and len(x) > 1:
            x = x - x.mean(axis=0)
        eff, se = x @ b, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", x, cov, x), 0))
        z = float(special.norm_ppf(1 - alpha / 2))
        wide = z
        if simultaneous and len(x) > 1:
            values, vectors = np.linalg.eigh(cov)
            draws = np.random.default_rng(seed).standard_normal((n_sim, len(b))) * np.sqrt(np.maximum(values, 0)) @ vectors.T @ x.T
            wide = float(np.quantile(np.max(np.abs(draws) / np.maximum(se, 1e-12), axis=1), 1 - alpha))
        out = []
        for v, e, s in zip(at, eff.tolist(), se.tolist(), strict=True):
            row = {"at": v, "log_relativity": e, "relativity": math.exp(e), "se_log_relativity": s, "ci_lower": math.exp(e - z * s), "ci_upper": math.exp(e + z * s)}
            if simultaneous:
                row |= {"ci_lower_simultaneous": math.exp(e - wide * s), "ci_upper_simultaneous": math.exp(e + wide * s)}
            out.append(row)
        return out

    def relativities(self, spark: SparkSession, name: str, **kw) -> DataFrame:
        """x or level, log_relativity, relativity, se_log_relativity, ci_lower, ci_upper."""
        rows = self.term_curve(name, **kw)
        key = "level" if isinstance(rows[0]["at"], str) else "x"
        return spark.createDataFrame([{key: r["at"], **{k: v for k, v in r.items() if k != "at"}} for r in rows]).select(key, *[k for k in rows[0] if k != "at"])

    def simultaneous_bands(self, spark: SparkSession, name: str, **kw) -> DataFrame:
        if not isinstance(self.term(name), Spline):
            raise TypeError("bands are for splines")
        return self.relativities(spark, name, simultaneous=True, **kw)

    def interaction_surface(self, spark: SparkSession, name: str, n_points: int = 30, alpha: float = 0.05) -> DataFrame:
        """Both parents' values, and the log-relativity over their grid with standard error and interval."""
        t = self.term(name)

        def grid(p: Term):
            if isinstance(p, Categorical):
                return np.array(p.levels, object)
            lo, hi = (p.lo, p.hi) if not isinstance(p, Numeric) else (0.0, 1.0)
            return np.linspace(lo, hi, n_points if not isinstance(p, Numeric) else 2)

        a, b = grid(t.left), grid(t.right)
        x, y = np.repeat(a, len(b)), np.tile(b, len(a))
        basis = t.raw({t.left.columns[0]: x, t.right.columns[0]: y})
        s = self.design.slices[name]
        eff, cov = basis @ self.beta(name), self.fit.covariance[1:, 1:][s, s]
        se = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", basis, cov, basis), 0))
        z = float(special.norm_ppf(1 - alpha / 2))
        rows = [(str(u), str(v), e, math.exp(e), d, math.exp(e - z * d), math.exp(e + z * d)) for u, v, e, d in zip(x, y, eff.tolist(), se.tolist(), strict=True)]
        return spark.createDataFrame(rows, "left string, right string, log_relativity double, relativity double, se_log_relativity double, ci_lower double, ci_upper double")

    def grouped_levels(self, spark: SparkSession, name: str, **kw) -> DataFrame:
        """The curve of a factor with grouped levels, one row for each original level with its group."""
        t = self.term(name)
        if not isinstance(t, Categorical) or t.grouping is None:
            raise TypeError("only for factors with a grouping")
        rows = {r["at"]: r for r in self.term_curve(name, **kw)}
        out = [(level, group, *(rows[group][k] for k in ("log_relativity", "relativity", "se_log_relativity", "ci_lower", "ci_upper"))) for level, group in t.grouping.mapping.items() if group in rows]
        return spark.createDataFrame(out, "level string, `group` string, log_relativity double, relativity double, se_log_relativity double, ci_lower double, ci_upper double")

    def basis_detail(self, spark: SparkSession, name: str) -> DataFrame:
        """idx, from, to, value, se of a smooth's B-spline (or knot value) coefficients, with the range each acts on."""
        t = self.term(name)
        if not isinstance(t, Spline):
            raise TypeError("only for splines")
        s, v = self.design.slices[name], np.array(t.vector)
        cov = t.transform @ self.fit.covariance[1:, 1:][s, s] @ t.transform.T
        value, se = t.transform @ self.beta(name), np.sqrt(np.maximum(np.diag(cov), 0))
        span = [(float(v[max(0, i - 1)]), float(v[min(len(v) - 1, i + 1)])) if t.kind == "cr_cardinal" else (float(v[i]), float(v[i + t.degree + 1])) for i in range(t.raw_size)]
        rows = [(i, max(a, t.lo), min(b, t.hi), float(x), float(e)) for i, ((a, b), x, e) in enumerate(zip(span, value, se, strict=True))]
        return spark.createDataFrame(rows, "idx int, `from` double, `to` double, value double, se double")

    def smooth_test(self, name: str) -> dict:
        """Wald test of a whole term over the range that its degrees of freedom allow.

        The rank is the trace of 2F - FF, with F the term's part of (X'WX + S)^-1 X'WX, and may be fractional: then the
        last whole direction is shared between two, and the tail is the mean of the two mixtures of chi-squares that
        the sharing can give. The quadratic form is taken over the term's values at the training rows (by X'WX).
        """
        s = slice(self.design.slices[name].start + 1, self.design.slices[name].stop + 1)
        cov, b = self.fit.covariance[s, s], self.fit.b[s]
        f = (self.fit.inverse @ self.fit.h)[s, s]
        edf, ref = float(np.trace(f)), float(2 * np.trace(f) - np.sum(f * f.T))
        root = adequacy.root_of(self.fit.h[s, s])
        stat, weights = adequacy.fractional_wald(root @ b, root @ cov @ root.T, min(max(ref, edf, 1e-3), len(b)))
        res = max(self.fit.n - self.fit.edf, 1.0)
        tail = (lambda w: special.chi2_mix_sf(stat, w)) if self.family.scale_known else (lambda w: special.f_mix_sf(stat, w, res))
        p = float(np.mean([tail(w) for w in weights]))
        return {"term": name, "edf": edf, "ref_df": float(sum(weights[0])), "statistic": stat, "p_value": min(1.0, max(0.0, p))}

    def diagnostics(self, spark: SparkSession) -> DataFrame:
        """term, active, group_norm, size, edf, and the term's smoothing parameters."""
        edf = self.group_edf()
        rows = [(t.name, bool(np.abs(self.beta(t.name)).max(initial=0) > 0), float(np.linalg.norm(self.beta(t.name))), t.size, edf[t.name], {k: float(v) for k, v in self.fit.lambdas.items() if k.split(":")[0] == t.name or k.startswith(t.name)}) for t in self.design.terms]
        return self._frame(spark, rows, "term string, active boolean, group_norm double, size int, edf double, lambdas map<string,double>")

    def knot_summary(self, spark: SparkSession) -> DataFrame:
        rows = [(t.name, t.kind, t.knot_strategy, t.interior(), [t.lo, t.hi], t.raw_size, t.degree, t.extrapolation) for t in self.design.terms if isinstance(t, Spline)]
        return self._frame(spark, rows, "feature string, kind string, knot_strategy string, interior_knots array<double>, boundary array<double>, n_basis int, degree int, extrapolation string")

    def iteration_diagnostics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(int(r["iteration"]), float(r.get("deviance", r.get("criterion"))), float(r.get("w_max", math.nan)), float(r.get("w_mean", math.nan)), float(r.get("intercept", math.nan)), int(r.get("step_halvings", 0))) for r in self.fit.trace], "iteration int, criterion double, w_max double, w_mean double, intercept double, step_halvings int")

    def summary(self, alpha: float = 0.05) -> str:
        """A text table of the fit."""
        lines = [f"{self.family.name}, {self.link.name} link; rows {self.fit.n}, deviance {self.fit.deviance:.4f}, edf {self.fit.edf:.3f}, phi {self.fit.phi:.5g}, {'converged' if self.fit.converged else 'not converged'} after {self.fit.n_iter}"]
        for t in self.design.terms:
            test = self.smooth_test(t.name)
            lines.append(f"{t.name:24s} {type(t).__name__:16s} edf {test['edf']:8.3f}  statistic {test['statistic']:12.4f}  p {test['p_value']:.4g}{'  near separation' if self.separated(t.name) else ''}")
        return "\n".join(lines)

    def separated(self, name: str) -> list[str]:
        """Levels with under 20 rows or 0.05% of the weight whose standard error stands out."""
        t = self.term(name)
        if not isinstance(t, Categorical) or not t.counts:
            return []
        se = np.sqrt(np.maximum(np.diag(self.fit.covariance[1:, 1:][self.design.slices[name], self.design.slices[name]]), 0))
        cut = max(50 * float(np.median(se)), 10.0)
        thin = {v for v, w, n in zip(t.levels, t.weights, t.counts, strict=True) if n < 20 or w < 0.0005 * sum(t.weights)}
        return [v for v, s in zip(t.others, se, strict=True) if v in thin or s > cut]

    # -- measures over data ----------------------------------------------------------------------------------------
    def metrics(self, df: DataFrame, y: str, weight=None, offset=None) -> DataFrame:
        """One row: n_obs, deviance, null deviance, Pearson, log-likelihood, explained deviance, AIC, BIC, AICc, EBIC."""
        scored = self.predict(df, offset, "__mu")
        # with an offset the null model is an intercept beside it, fitted; without, the weighted mean
        null = replace(self.spec, terms=(), penalty=None).fit(df, y, weight, offset).mean(offset) if offset else None
        row = adequacy.fit_stats(scored, y, "__mu", self.family, weight, self.fit.phi, null).first().asDict()
        if row["log_likelihood"] is None:
            row["log_likelihood"] = adequacy.log_likelihood(scored, y, "__mu", self.family, weight, self.fit.phi)
        more = adequacy.information(row["log_likelihood"], self.fit.edf, row["n_obs"])
        active = sum(bool(np.abs(self.beta(t.name)).max(initial=0) > 0) for t in self.design.terms)
        values = {k: float(v) if v is not None and k != "n_obs" else v for k, v in row.items() if k != "null_log_likelihood"} | more | {"ebic": adequacy.ebic(more["bic"], active, len(self.design.terms)), "edf": self.fit.edf, "phi": self.fit.phi}
        return df.sparkSession.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if k == 'n_obs' else 'double'}" for k in values))

    def influence(self, df: DataFrame, y: str, weight=None, offset=None) -> DataFrame:
        """df with mu, leverage, cooks_distance, std_deviance_residual and std_pearson_residual."""
        inv, design, family, link, phi, b, edf = self.fit.inverse, self.design, self.family, self.link, self.fit.phi, self.fit.b, self.fit.edf
        o = F.lit(0.0)
        for c in [offset] if isinstance(offset, str) else list(offset or []):
            o = o + F.col(f"`{c}`").cast("double")
        given = df.withColumns({"__y": F.col(f"`{y}`").cast("double"), "__w": adequacy._w(weight), "__o": o})
        names = ["mu", "leverage", "cooks_distance", "std_deviance_residual", "std_pearson_residual"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + "".join(f", {n} double" for n in names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
                x, yy, w = design.matrix(data), data["__y"].astype(float), data["__w"].astype(float)
                mu, big, _ = irls_weights(family, link, x @ b + data["__o"].astype(float), w)
                hat = np.clip(big * np.einsum("ij,jk,ik->i", x, inv, x), 0, 1)
                rest = np.sqrt(phi * np.maximum(1 - hat, 1e-10))
                pearson = (yy - mu) * np.sqrt(w / family.variance(mu))
                dev = np.sign(yy - mu) * np.sqrt(np.maximum(w * family.deviance(yy, mu), 0))
                cook = (pearson / rest) ** 2 * hat / (np.maximum(1 - hat, 1e-10) * edf)
                keep = [i for i, n in enumerate(batch.schema.names) if n not in ("__y", "__w", "__o")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(v) for v in (mu, hat, cook, dev / rest, pearson / rest))], names=[*(batch.schema.names[i] for i in keep), *names])

        return given.mapInArrow(run, schema)

    def term_importance(self, df: DataFrame, weight=None) -> DataFrame:
        """term, variance_eta, sd_eta, edf, group_norm: weighted variance of each term's contribution; one pass."""
        w = adequacy._w(weight)
        terms, edf = self.design.terms, self.group_edf()
        aggs = [F.sum(w).alias("w")]
        for i, t in enumerate(terms):
            e = t.effect(self.beta(t.name))
            aggs += [F.sum(w * e).alias(f"a{i}"), F.sum(w * e * e).alias(f"b{i}")]
        row = df.agg(*aggs).first()
        out = []
        for i, t in enumerate(terms):
            var = max(0.0, row[f"b{i}"] / row["w"] - (row[f"a{i}"] / row["w"]) ** 2)
            out.append((t.name, var, math.sqrt(var), edf[t.name], float(np.linalg.norm(self.beta(t.name)))))
        return self._frame(df.sparkSession, sorted(out, key=lambda r: -r[1]), "term string, variance_eta double, sd_eta double, edf double, group_norm double")

    def drop1(self, df: DataFrame, y: str, weight=None, offset=None, test: str = "Chisq") -> DataFrame:
        """feature, deviance_full, deviance_reduced, delta_deviance, delta_df, statistic, p_value, delta_aic."""
        out = []
        for t in self.spec.terms:
            if isinstance(t, Interaction):
                less = replace(self.spec, terms=tuple(x for x in self.spec.terms if x.name != t.name))
            else:
                less = self.spec.without([t.name])
            small = less.fit(df, y, weight, offset) if not self._estimated() else less.fit_reml(df, y, weight, offset)
            d, k = small.fit.deviance - self.fit.deviance, max(self.fit.edf - small.fit.edf, 1e-8)
            if test == "F":
                stat = d / k / self.fit.phi
                p = special.f_sf(stat, k, max(self.fit.n - self.fit.edf, 1))
            else:
                stat = d / self.fit.phi
                p = special.chi2_sf(stat, k)
            out.append((t.name, self.fit.deviance, small.fit.deviance, d, k, stat, p, d / self.fit.phi - 2 * k))
        return self._frame(df.sparkSession, out, "feature string, deviance_full double, deviance_reduced double, delta_deviance double, delta_df double, statistic double, p_value double, delta_aic double")

    def _estimated(self) -> bool:
        return bool(self.fit.trace) and "criterion" in self.fit.trace[0]

    def refit_unpenalised(self, df: DataFrame, y: str, weight=None, offset=None, keep_smoothing: bool = True) -> Model:
        """Active terms again, without the group penalty."""
        idle = [t.name for t in self.design.terms if not np.abs(self.beta(t.name)).max(initial=0) > 0]
        spec = replace(self.spec.without(idle), penalty=None)
        if not keep_smoothing:
            spec = replace(spec, spline_penalty=0.0)
        return spec.fit(df, y, weight, offset)

    def holdout_drop(self, df: DataFrame, y: str, weight=None, offset=None) -> DataFrame:
        """feature, delta_deviance: the rise of the mean deviance if a term is set to zero; one pass."""
        w, obs = adequacy._w(weight), F.col(f"`{y}`").cast("double")
        at = lambda e: self.family.clip(self.link.inverse(self.link.stabilise(e)))
        full = self.eta(offset)
        aggs = [F.sum(w).alias("w"), F.sum(w * self.family.deviance(obs, at(full))).alias("d")]
        aggs += [F.sum(w * self.family.deviance(obs, at(full - t.effect(self.beta(t.name))))).alias(f"d{i}") for i, t in enumerate(self.design.terms)]
        row = df.agg(*aggs).first()
        return self._frame(df.sparkSession, [(t.name, (row[f"d{i}"] - row["d"]) / row["w"]) for i, t in enumerate(self.design.terms)], "feature string, delta_deviance double")

    def monotonised(self, df: DataFrame, weight=None, n_grid: int = 500) -> tuple[Model, DataFrame]:
        """Splines marked postfit made monotone on a weighted grid; the model and a report of the violations."""
        b, report = self.fit.b.copy(), []
        for t in self.design.terms:
            if not (isinstance(t, Spline) and t.constraint and t.constraint.mode == "postfit"):
                continue
            grid = np.linspace(t.lo, t.hi, n_grid)
            x = F.col(f"`{t.column}`").cast("double")
            mass = {r["i"]: r["m"] for r in df.groupBy(F.least(F.greatest(F.round((x - t.lo) / (t.hi - t.lo) * (n_grid - 1)), F.lit(0)), F.lit(n_grid - 1)).cast("int").alias("i")).agg(F.sum(adequacy._w(weight)).alias("m")).collect()}
            w = np.array([mass.get(i, 0.0) for i in range(n_grid)]) + 1e-6
            s = self.design.slices[t.name]
            basis = t.design({t.column: grid})
            old = basis @ self.beta(t.name)
            goal = special.isotonic(old, w, t.constraint.kind == "increasing")
            raw = splines.monotone_rows(t.raw_size, t.constraint.kind) @ t.transform
            h = basis.T @ (basis * w[:, None])
            new = splines.solve_qp(h + 1e-9 * np.trace(h) / len(h) * np.eye(len(h)), basis.T @ (w * goal), raw, np.zeros(len(raw)))
            b[s.start + 1 : s.stop + 1] = new
            report.append((t.name, t.constraint.kind, violation(old, t.constraint.kind), violation(basis @ new, t.constraint.kind)))
        out = replace(self, fit=replace(self.fit, b=b))
        return out, self._frame(df.sparkSession, report, "feature_name string, direction string, max_violation_before double, max_violation_after double")

    def discretization_impact(self, df: DataFrame, y: str, weight=None, offset=None, n_bins: int = 100, strategy: str = "exposure_quantile", features: Sequence[str] | None = None, ties: Sequence[str] = ()) -> tuple[dict[str, DataFrame], DataFrame]:
        """Each smooth replaced by its weighted bin averages: rating tables, and the change of deviance and predictions."""
        tables, change, w = {}, F.lit(0.0), adequacy._w(weight)
        for t in self.design.terms:
            if not isinstance(t, Spline) or (features and t.name not in features):
                continue
            x, e = F.col(f"`{t.column}`").cast("double"), t.effect(self.beta(t.name))
            edges = charts.uniform_edges(df, t.column, n_bins) if strategy == "uniform" else charts.winsorised_edges(df, t.column, weight, n_bins, ties) if strategy == "winsorized" else charts.weighted_quantile_edges(df, t.column, weight, n_bins, ties)
            got = df.groupBy(charts.edge_bin(x, edges).alias("b")).agg((F.sum(w * e) / F.sum(w)).alias("v"), F.count("*").alias("n"), F.sum(w).alias("w")).orderBy("b").collect()
            rows = [(edges[r["b"]], edges[min(r["b"] + 1, len(edges) - 1)], math.exp(r["v"]), r["v"], r["n"], r["w"]) for r in got]
            tables[t.name] = self._frame(df.sparkSession, rows, "bin_from double, bin_to double, relativity double, log_relativity double, n_obs long, sample_weight double")
            mean_of = {r["b"]: r["v"] for r in got}
            change = change + F.get(F.array(*(F.lit(float(mean_of.get(b, 0.0))) for b in range(len(edges)))), charts.edge_bin(x, edges)) - e
        at = lambda eta: self.family.clip(self.link.inverse(self.link.stabilise(eta)))
        scored = df.select(F.col(f"`{y}`").cast("double").alias("y"), w.alias("w"), at(self.eta(offset)).alias("a"), at(self.eta(offset) + change).alias("b"))
        out = scored.agg(F.sum(F.col("w") * self.family.deviance(F.col("y"), F.col("a"))).alias("deviance_original"), F.sum(F.col("w") * self.family.deviance(F.col("y"), F.col("b"))).alias("deviance_discretized"), F.corr("a", "b").alias("correlation"), F.max(F.abs(F.col("b") / F.col("a") - 1)).alias("max_relative_change"), F.avg(F.abs(F.col("b") / F.col("a") - 1)).alias("mean_relative_change"))
        return tables, out

    def spline_redundancy(self, df: DataFrame, weight=None) -> DataFrame:
        """feature, knot spacings, share of weight between knots, neighbouring basis correlations, effective rank."""
        out, w = [], adequacy._w(weight)
        for t in self.design.terms:
            if not isinstance(t, Spline):
                continue
            edges = [t.lo, *t.interior(), t.hi]
            got = {r["b"]: r["w"] for r in df.groupBy(charts.edge_bin(F.col(f"`{t.column}`").cast("double"), edges).alias("b")).agg(F.sum(w).alias("w")).collect()}
            total = sum(got.values())
            mass = [got.get(i, 0.0) / total for i in range(len(edges) - 1)]
            grid = np.linspace(t.lo, t.hi, 1000)
            g = t.basis(grid)
            at = np.clip(np.searchsorted(edges, grid, side="right") - 1, 0, len(mass) - 1)
            weights = np.array(mass)[at] / np.maximum(np.bincount(at, minlength=len(mass))[at], 1)
            gram = g.T @ (g * weights[:, None])
            scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
            near = np.diag(gram, 1) / (scale[1:] * scale[:-1])
            values = np.linalg.svd(gram / scale[:, None] / scale, compute_uv=False)
            share = values / values.sum()
            out.append((t.name, len(edges) - 2, np.diff(edges).tolist(), mass, near.tolist(), float(np.exp(-(share * np.log(np.maximum(share, 1e-300))).sum())), int((values < 1e-6 * values.max()).sum())))
        return self._frame(df.sparkSession, out, "feature_name string, n_knots int, knot_spacing array<double>, support_mass array<double>, adjacent_basis_corr array<double>, effective_rank double, small_singular_values int")


def violation(values, direction: str) -> float:
    """The largest step the wrong way."""
    d = np.diff(np.asarray(values, float)) * (1 if direction == "increasing" else -1)
    return float(max(0.0, -d.min(initial=0.0)))


__all__ = ["Glm", "LambdaPolicy", "Model", "Profile", "violation"]
