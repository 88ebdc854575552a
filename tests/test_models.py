import dataclasses

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from premia import queries
from premia.functions import families, links, special
from premia.model import Glm, violation
from premia.operators import adequacy, charts, frame, splines
from premia.operators.terms import Categorical, Constraint, Interaction, LambdaPolicy, Numeric, OrderedCategorical, Polynomial, Spline, Stats, TensorInteraction, collapse_levels, detect, n_knots_from_k
from premia.plans import scop, select, smoothing, solve
from premia.sources import store
from premia.streaming import score


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    n = 1500
    age, density, region, w = rng.uniform(18, 85, n), rng.normal(5, 2, n), rng.choice(["A", "B", "C"], n), rng.uniform(0.3, 1, n)
    y = rng.poisson(np.exp(0.3 + 0.0008 * (age - 50) ** 2 + 0.3 * (region == "B")))
    rows = [(float(a), float(d), str(r), float(v), float(c), i % 4) for i, (a, d, r, v, c) in enumerate(zip(age, density, region, w, y))]
    return spark.createDataFrame(rows, "age double, density double, region string, w double, y double, fold int").cache()


def arrays(df, *cols):
    p = df.toPandas()
    return [p[c].to_numpy() for c in cols]


def test_fit_solves_the_score_equations(data):
    model = Glm("poisson", [Numeric("density"), Categorical("region")]).fit(data, "y", "w")
    y, w, d, mu, r = arrays(model.predict(data, name="mu"), "y", "w", "density", "mu", "region")
    assert abs((w * (y - mu)).sum()) < 1e-4 and abs((w * (y - mu) * d).sum()) < 1e-3
    for level in "ABC":
        assert abs((w * (y - mu))[r == level].sum()) < 1e-4


def test_cells_and_partitions_agree(data, monkeypatch):
    spec = Glm("poisson", [Spline("age", n_knots=5), Categorical("region")])
    a = spec.fit(data, "y", "w")
    monkeypatch.setattr("premia.operators.frame.MAX_CELLS", 10)
    b = spec.fit(data, "y", "w")
    assert np.allclose(a.fit.b, b.fit.b, atol=1e-6) and a.fit.deviance == pytest.approx(b.fit.deviance)


@pytest.mark.parametrize("kind", ["ps", "bs", "ns", "cr", "cr_cardinal"])
@pytest.mark.parametrize("extrapolation", ["clip", "extend"])
def test_spline_column_equals_its_basis(spark, data, kind, extrapolation):
    model = Glm("poisson", [Spline("age", kind=kind, n_knots=6, extrapolation=extrapolation)]).fit(data, "y")
    x = np.linspace(10, 95, 40)
    df = spark.createDataFrame([(float(v),) for v in x], "age double")
    got = np.array([r[0] for r in df.select(model.eta()).collect()])
    want = model.fit.intercept + model.term("age").design({"age": x}) @ model.beta("age")
    assert np.allclose(got, want, atol=1e-6)


def test_spline_is_centred_over_the_rows(data):
    model = Glm("poisson", [Spline("age", kind="cr", n_knots=6)]).fit(data, "y", "w")
    assert abs(data.select(F.avg(model.term("age").effect(model.beta("age")))).first()[0]) < 1e-8


def test_error_extrapolation_and_unseen_levels(spark, data):
    model = Glm("poisson", [Spline("age", extrapolation="error"), Categorical("region")]).fit(data, "y")
    for row in [(200.0, "A"), (50.0, "Z"), (50.0, None)]:
        with pytest.raises(Exception, match="training range|unknown level"):
            model.predict(spark.createDataFrame([row], "age double, region string")).collect()


def test_reml_finds_the_curve_and_drops_noise(data):
    model = Glm("poisson", [Spline("age", kind="cr", n_knots=8), Spline("density", kind="cr", n_knots=8)]).fit_reml(data, "y")
    edf = model.group_edf()
    assert model.fit.converged and edf["age"] > 2 and edf["density"] < 2.5
    curve = np.array([r["log_relativity"] for r in model.term_curve("age", 50)])
    truth = 0.0008 * (np.linspace(18, 85, 50) - 50) ** 2
    assert np.corrcoef(curve, truth)[0, 1] > 0.97


def test_reml_is_near_the_criterions_minimum(data):
    spec = lambda lam: Glm("gaussian", [Spline("age", kind="cr", n_knots=8, lambda_policy=LambdaPolicy.fixed(lam))])
    best = Glm("gaussian", [Spline("age", kind="cr", n_knots=8)]).fit_reml(data, "y")
    lam = best.fit.lambdas["age"]

    def value(x):
        m = spec(x).fit(data, "y")
        return smoothing.Criterion(m.family, [p for _, p, _ in m.design.penalties()], m.fit.n).value(m.fit.deviance, m.fit.h, m.fit.b, np.array([x]))

    assert value(lam) <= value(lam * 1.5) + 1e-6 and value(lam) <= value(lam / 1.5) + 1e-6


def test_penalty_limits(data):
    spec = Glm("poisson", [Categorical("region"), Numeric("density")])
    top = spec.lambda_max(data, "y")
    none = Glm("poisson", spec.terms, penalty=solve.GroupLasso(top * 1.001)).fit(data, "y")
    some = Glm("poisson", spec.terms, penalty=solve.GroupLasso(top * 0.5)).fit(data, "y")
    free = Glm("poisson", spec.terms, penalty=solve.GroupLasso(0.0)).fit(data, "y")
    assert np.abs(none.fit.beta).max() == 0 and np.abs(some.fit.beta).max() > 0
    assert np.allclose(free.fit.b, spec.fit(data, "y").fit.b, atol=1e-4)
    for kind in (solve.SparseGroupLasso, solve.GroupElasticNet, solve.Ridge):
        assert kind(top * 0.5) and np.isfinite(Glm("poisson", spec.terms, penalty=kind(top * 0.5)).fit(data, "y").fit.deviance)
    with pytest.raises(ValueError, match="unknown terms"):
        Glm("poisson", spec.terms, penalty=solve.GroupLasso(1.0, features=["nope"])).fit(data, "y")
    adaptive = Glm("poisson", spec.terms, penalty=solve.GroupLasso(top * 0.3, adaptive=solve.Adaptive())).fit(data, "y")
    assert np.isfinite(adaptive.fit.deviance)


def test_prox_minimises():
    rng = np.random.default_rng(3)
    for kind in ("group_lasso", "sparse_group_lasso", "group_elastic_net", "ridge"):
        p = solve.GroupPenalty(kind, 1.0)
        v = rng.normal(size=4)
        x = p.prox(v, 0.7, 1.3, 0.4)
        f = lambda z: ((z - v) ** 2).sum() / 1.4 + p.value(z, 1.3, 0.4)
        assert all(f(x) <= f(x + rng.normal(scale=0.05, size=4)) + 1e-12 for _ in range(100))


class Arrays(frame.Source):
    """Sums over arrays, without Spark."""

    def __init__(self, terms, data, y, w, family):
        self.design = frame.Design(terms)
        self.x = self.design.matrix(data | {"__y": y})
        self.part = {"w": w, "y": y, "o": np.zeros(len(y)), "n": np.ones(len(y)), "a": w * family.a(y), "yy": w * y * y}

    def over(self, kernel):
        return kernel(self.x, self.part)


def smooths(family, seed=0, n=500, **kw):
    """A source with two smooths, one with two penalties, learned from arrays."""
    rng = np.random.default_rng(seed)
    data = {"a": rng.random(n), "b": rng.random(n)}
    mean = np.exp(0.5 + np.sin(5 * data["a"]) + 0.3 * data["b"])
    y = {"poisson": lambda: rng.poisson(mean) * 1.0, "gamma": lambda: rng.gamma(2.0, mean / 2), "gaussian": lambda: mean + rng.normal(size=n), "binomial": lambda: (rng.random(n) < mean / mean.max()) * 1.0}[family.name]()
    w, terms = rng.uniform(0.5, 1.5, n), []
    for t in (Spline("a", n_knots=6, lo=0.0, hi=1.0, **kw), Spline("b", kind="bs", n_knots=5, lo=0.0, hi=1.0, m=(1, 2))):
        t = dataclasses.replace(t, vector=tuple(splines.open_knots(splines.uniform_knots(0.0, 1.0, t.n_knots), 0.0, 1.0, t.degree).tolist()))
        raw = t.raw(data)
        terms.append(t.finished(raw.sum(axis=0), (raw * w[:, None]).T @ raw, w.sum(), 0.1))
    return Arrays(terms, data, y, w, family), {"n": n, "w": float(w.sum()), "mean": float((w * y).sum() / w.sum())}


@pytest.mark.parametrize("family,link", [("poisson", "log"), ("gamma", "log"), ("gaussian", "identity"), ("binomial", "cloglog"), ("binomial", "logit")])
def test_derivatives_of_the_criterion(family, link):
    """Gradient and Hessian against differences of refitted criteria; without the moving weights they are not right."""
    family, link = families.resolve(family), links.NAMED[link]()
    source, info = smooths(family)
    parts = [p for _, p, _ in source.design.penalties()]
    criterion = smoothing.Criterion(family, parts, info["n"])

    def at(rho):
        lams = np.exp(rho)
        s = criterion.penalty(lams, source.design.size + 1)
        fit = solve.irls(source, family, link, info, s[1:, 1:], tol=1e-15, max_iter=300)
        inv = solve.safe_inverse(fit.h + s)
        rough = np.array([-inv @ (x * p @ fit.b) for x, p in zip(lams, criterion.parts)])
        more = source.curvature(fit.b, family, link, inv, rough)
        return criterion.value(fit.deviance, fit.h, fit.b, lams), *criterion.derivatives(fit.deviance, fit.h, fit.b, lams, more), criterion.derivatives(fit.deviance, fit.h, fit.b, lams)[0]

    rho, e = np.log([2.0, 0.5, 9.0]), 1e-4
    _, grad, hess, fixed = at(rho)
    steps = [(at(rho + e * d), at(rho - e * d)) for d in np.eye(3)]
    assert np.abs(grad - [(u[0] - v[0]) / (2 * e) for u, v in steps]).max() < 1e-6
    assert np.abs(hess - [(u[1] - v[1]) / (2 * e) for u, v in steps]).max() < (1e-5 if link.name != "cloglog" else 5e-3)
    if family.name in ("poisson", "binomial"):
        assert np.abs(fixed - grad).max() > 1e-4


def test_newton_finds_the_minimum_from_anywhere():
    family, link = families.poisson(), links.Log()
    source, info = smooths(family, seed=3)
    found = [smoothing.smooth(source, family, link, info, source.design.penalties(), first=x) for x in (1e-4, 1.0, 1e4)]
    values = [f.trace[-1]["criterion"] for f in found]
    assert all(f.converged for f in found) and max(values) - min(values) < 1e-5
    assert np.ptp([f.edf for f in found]) < 1e-2


def test_log_determinants():
    """Closed forms and the stable way against exact arithmetic on diagonals, and their derivatives."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(7, 7)))[0]
    one, two = q[:, :4] @ np.diag([1.0, 2, 3, 4]) @ q[:, :4].T, q[:, 3:] @ np.diag([5.0, 1, 2, 6]) @ q[:, 3:].T
    mixed = (lambda a: a @ a.T)(rng.normal(size=(7, 3)))
    pair = [np.kron(np.diag([0.0, 1, 2]), np.eye(3)), np.kron(np.eye(3), np.diag([0.0, 0, 4]))]
    for parts in ([one], [one, two], [one, mixed], pair):
        log_det = smoothing.LogDet(parts)
        for lams in (np.array([2.0, 0.3]), np.array([1e-5, 1e5]), np.array([1e7, 1e-4])):
            lams, e = lams[: len(parts)], 1e-5
            value, grad, hess = log_det(lams)
            s = sum(x * p for x, p in zip(lams, parts))
            if lams.max() / lams.min() < 100:
                eig = np.linalg.eigvalsh(s)
                some = eig[eig > 1e-9 * eig.max()]
                assert abs(value - np.log(some).sum()) < 1e-6 and log_det.rank == len(some)
            moved = [(log_det(lams * np.exp(e * d)), log_det(lams * np.exp(-e * d))) for d in np.eye(len(parts))]
            assert np.allclose(grad, [(u[0] - v[0]) / (2 * e) for u, v in moved], atol=1e-4)
            assert np.allclose(hess, [(u[1] - v[1]) / (2 * e) for u, v in moved], atol=1e-4)
    assert abs(smoothing.stable_log_det([one, two], [1e14, 1e-6]) - smoothing.LogDet([one, two])(np.array([1e14, 1e-6]))[0]) < 1e-4


def test_scop_newton(data):
    """Monotone by construction, the score is zero in the parameters, and smoothing is estimated."""
    spec = Glm("poisson", [Spline("age", kind="ps", n_knots=6, constraint=Constraint.fit.increasing), Categorical("region")])
    fitted, free = spec.fit(data, "y", "w"), spec.fit_reml(data, "y", "w")
    for m in (fitted, free):
        assert m.fit.converged and (np.diff([r["log_relativity"] for r in m.term_curve("age", 300)]) >= -1e-12).all()
        up = np.concatenate([[False], scop.positive(type("S", (), {"design": m.design}))[1:]])
        theta = np.where(up, np.log(np.maximum(m.fit.b, 1e-300)), m.fit.b)
        s = sum(m.fit.lambdas[n] * solve.padded(p) for n, p, _ in m.design.penalties())
        grad = np.where(up, m.fit.b, 1.0) * m.fit.score - s @ theta
        assert np.abs(grad[theta > scop.LOWEST + 1e-6]).max() < 1e-2
    assert 1 < free.fit.edf < 12 and free.fit.lambdas["age"] != 0.1
    with pytest.raises(ValueError, match="interaction"):
        Glm("poisson", [Interaction(spec.terms[0], Categorical("region"))]).fit(data, "y")
    with pytest.raises(ValueError, match="group penalty"):
        Glm("poisson", spec.terms, penalty=solve.GroupLasso(0.1)).fit(data, "y")


def test_scop_beats_no_other_monotone_fit(data):
    """At no smoothing its deviance is near that of the best step function that rises."""
    p = data.groupBy(F.round(F.col("age") / 5).alias("age")).agg(F.sum("y").alias("s"), F.count("*").alias("n")).orderBy("age").toPandas()
    best = special.isotonic(p["s"] / p["n"], p["n"])
    rounded = data.withColumn("age", F.round(F.col("age") / 5))
    m = Glm("poisson", [Spline("age", n_knots=12, constraint=Constraint.fit.increasing, lambda_policy=LambdaPolicy.fixed(1e-6))], tol=1e-12).fit(rounded, "y")
    mu = m.predict(p.pipe(lambda d: data.sparkSession.createDataFrame(d)), name="mu").orderBy("age").toPandas()["mu"].to_numpy()
    value = lambda v: float((p["s"] * np.log(v) - p["n"] * v).sum())
    assert value(best) + 1e-6 >= value(mu) >= value(best) - 3.0


def test_sums_in_groups_of_partitions(data, monkeypatch):
    spec = Glm("poisson", [Spline("age", n_knots=4), Categorical("region")])
    want = spec.fit(data, "y", "w").fit.b
    with frame.rows_only():
        assert np.allclose(spec.fit(data.repartition(7), "y", "w").fit.b, want, atol=1e-8)
        monkeypatch.setattr(frame, "GROUPS", 2)
        assert np.allclose(spec.fit(data.repartition(7), "y", "w").fit.b, want, atol=1e-8)
    assert frame.MAX_CELLS > 0


def test_fractional_wald():
    """Whole ranks are plain Wald tests; in between the expectation under no effect is the rank."""
    rng = np.random.default_rng(2)
    a = rng.normal(size=(5, 5))
    cov = a @ a.T
    x = rng.normal(size=5)
    assert abs(adequacy.fractional_wald(x, cov, 5.0)[0] - x @ np.linalg.solve(cov, x)) < 1e-8
    for rank in (1.0, 1.4, 2.75, 4.0):
        draws = rng.multivariate_normal(np.zeros(5), cov, 4000)
        stats = np.array([adequacy.fractional_wald(d, cov, rank)[0] for d in draws])
        weights = adequacy.fractional_wald(x, cov, rank)[1]
        assert abs(sum(weights[0]) - rank) < 1e-9 and abs(stats.mean() - rank) < 0.15
        p = np.mean([np.mean([special.chi2_mix_sf(s, w) for w in weights]) < 0.1 for s in stats[:400]])
        assert 0.05 < p < 0.16
    assert abs(special.f_mix_sf(3.0, [1.0], 7.0) - special.f_sf(3.0, 1, 7)) < 2e-3


def test_smooth_test_and_details(data, spark):
    model = Glm("poisson", [Spline("age", kind="cr", n_knots=8), Spline("density", kind="cr", n_knots=8)]).fit_reml(data, "y")
    age, density = model.smooth_test("age"), model.smooth_test("density")
    assert age["p_value"] < 1e-6 < density["p_value"] and age["ref_df"] >= age["edf"] - 1e-9
    detail = model.basis_detail(spark, "age").toPandas()
    assert len(detail) == model.term("age").raw_size and (detail["se"] >= 0).all() and (detail["from"] <= detail["to"]).all()
    grouped = Glm("poisson", [Categorical("region", grouping=collapse_levels(["A", "B", "C"], from_level="B"))]).fit(data, "y")
    rows = {r["level"]: r for r in grouped.grouped_levels(spark, "region").collect()}
    assert set(rows) == {"A", "B", "C"} and rows["B"]["relativity"] == rows["C"]["relativity"] and rows["B"]["group"] == "B+"


@pytest.mark.parametrize("kind", ["increasing", "decreasing"])
def test_monotone_fit_and_repair(data, kind):
    fitted = Glm("poisson", [Spline("age", kind="bs", n_knots=6, constraint=getattr(Constraint.fit, kind))]).fit(data, "y")
    assert violation([r["log_relativity"] for r in fitted.term_curve("age")], kind) < 1e-6
    loose = Glm("poisson", [Spline("age", kind="bs", n_knots=6, constraint=getattr(Constraint.postfit, kind))]).fit(data, "y")
    fixed, report = loose.monotonised(data, "w")
    row = report.first()
    assert row["max_violation_before"] > 1e-3 and row["max_violation_after"] < 1e-6
    assert violation([r["log_relativity"] for r in fixed.term_curve("age")], kind) < 1e-6


def test_monotone_repair_of_a_bend(spark, tmp_path):
    """Means that bend far more than their line rises: the query is about the line, as its SQL is."""
    rows = [(float(q), 1000.0 * (q - 25.5) ** 2 + q) for q in range(1, 51) for _ in range(40)]
    spark.createDataFrame(rows, "l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in queries.QUERIES["monotone_repair"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == {(d, b, float(a)) for d, b, a in con.sql(queries.ORACLE_SQL["monotone_repair"]).fetchall()}


def test_interactions_and_tensor(data):
    a, r = Spline("age", n_knots=4), Categorical("region")
    d = Polynomial("density", 2)
    for term in (Interaction(a, r), Interaction(d, r), Interaction(Numeric("density"), r), Interaction(Numeric("density"), Numeric("age")), TensorInteraction(a, Spline("density", n_knots=3))):
        model = Glm("poisson", [term.left, term.right, term] if term.left.name != term.right.name else [term]).fit(data, "y")
        p = model.predict(data, name="mu").limit(20).toPandas()
        x = model.design.matrix({c: p[c].to_numpy() for c in ("age", "density", "region")} | {"__y": p["y"].to_numpy()})
        assert np.allclose(np.exp(x @ model.fit.b), p["mu"], rtol=1e-6)
    with pytest.raises(ValueError):
        TensorInteraction(Spline("age", select=True), Spline("density"))


def test_ordered_and_grouped(data):
    for basis in ("spline", "step"):
        model = Glm("poisson", [OrderedCategorical("region", order=("A", "B", "C"), basis=basis)]).fit(data, "y")
        assert len(model.term_curve("region")) == 3
    g = collapse_levels(["A", "B", "C"], groups={"AB": ["A", "B"]})
    assert dict(g.mapping) == {"A": "AB", "B": "AB", "C": "C"}
    assert dict(collapse_levels(["A", "B", "C"], below="C").mapping)["A"] == "<C"
    with pytest.raises(ValueError):
        collapse_levels(["A", "B"], from_level="A", below="B")
    with pytest.raises(ValueError):
        collapse_levels(["A", "B"], groups={"x": ["A"], "y": ["A"]})
    assert Glm("poisson", [Categorical("region", grouping=g)]).fit(data, "y").design.size == 1


def test_detection_and_knots(data):
    kinds = [type(t).__name__ for t in detect(data, ["age"], 5, ["y", "w", "fold"])]
    assert kinds == ["Spline", "Numeric", "Categorical"]
    assert n_knots_from_k("ps", 10) == 6 and n_knots_from_k("cr", 10) == 8 and n_knots_from_k("cr_cardinal", 10) == 8
    with pytest.raises(ValueError):
        n_knots_from_k("ps", 3)


def test_bad_input_is_rejected(spark, data):
    with pytest.raises(ValueError, match="invalid"):
        Glm("gamma", [Numeric("age")]).fit(data, "y")
    with pytest.raises(ValueError, match="two levels"):
        Glm("poisson", [Categorical("region")]).fit(data.filter("region = 'A'"), "y")
    with pytest.raises(ValueError, match="missing"):
        Glm("poisson", [Numeric("age")]).fit(data.withColumn("age", F.lit(None).cast("double")), "y")
    with pytest.raises(ValueError, match="no rows"):
        Glm("poisson", [Numeric("age")]).fit(data.limit(0), "y")


def test_residuals_and_influence(data):
    model = Glm("poisson", [Categorical("region"), Numeric("density")]).fit(data, "y")
    out = model.influence(data, "y").toPandas()
    assert out["leverage"].sum() == pytest.approx(model.fit.edf, abs=1e-6) and (out["cooks_distance"] >= 0).all()
    q = adequacy.residuals(model.predict(data, name="mu"), "y", "mu", model.family, model.link, "quantile").toPandas()["residual"]
    assert abs(q.mean()) < 0.15 and np.isfinite(q).all()


def test_drop_importance_and_reports(spark, data):
    model = Glm("poisson", [Spline("age", n_knots=5), Categorical("region")]).fit_reml(data, "y")
    assert {r["feature"] for r in model.drop1(data, "y").collect()} == {"age", "region"}
    assert all(r["delta_deviance"] > 0 for r in model.holdout_drop(data, "y").collect())
    assert model.term_importance(data, "w").first()["term"] == "age"
    assert "age" in model.summary() and model.diagnostics(spark).count() == 2 and model.knot_summary(spark).count() == 1
    assert model.iteration_diagnostics(spark).count() >= 1 and model.spline_redundancy(data).count() == 1
    tables, impact = model.discretization_impact(data, "y", n_bins=30)
    assert tables["age"].count() <= 30 and impact.first()["correlation"] > 0.95
    bands = model.simultaneous_bands(spark, "age", n_points=20, n_sim=500).toPandas()
    assert (bands["ci_upper_simultaneous"] >= bands["ci_upper"] - 1e-9).all()
    refit = model.refit_unpenalised(data, "y", keep_smoothing=False)
    assert refit.fit.deviance <= model.fit.deviance + 1e-6


def test_charts_add_up(data):
    scored = Glm("poisson", [Spline("age", n_knots=5)]).fit(data, "y", "w").predict(data, name="mu")
    lift = charts.lift(scored, "y", "mu", "w", n_bins=7).toPandas()
    assert lift["exposure_share"].sum() == pytest.approx(1) and len(lift) == 7
    p = scored.toPandas().sort_values("mu", kind="stable")
    w, y = p["w"].to_numpy(), p["y"].to_numpy()
    x, v = np.concatenate([[0], np.cumsum(w) / w.sum()]), np.concatenate([[0], np.cumsum(w * y) / (w * y).sum()])
    assert charts.gini(scored, "y", "mu", "w").first()["gini_model"] == pytest.approx(1 - 2 * np.trapezoid(v, x), abs=1e-9)
    curve = charts.lorenz(scored, "y", "mu", "w").toPandas().sort_values("cum_exposure_share")
    assert (np.diff(curve["cum_loss_share_perfect"]) >= -1e-12).all() and curve.iloc[-1]["cum_loss_share_model"] == pytest.approx(1)


def test_cross_validation(data):
    cv = select.cross_validate(Glm("poisson", [Categorical("region")]), data, "y", "fold", "w", scoring=("deviance", "nll", "gini"), oof=True)
    assert cv.folds.count() == 4 and cv.oof.count() == data.count() and len(cv.models) == 4
    assert cv.scores.filter("metric = 'deviance'").first()["pooled"] > 0
    assert len(select.curve_similarity(cv.models, "region")) == 6


def test_profiles(spark):
    rng = np.random.default_rng(5)
    y = rng.poisson(rng.gamma(3.0, 2.0 / 3.0, 3000))
    df = spark.createDataFrame([(float(v), "AB"[i % 2]) for i, v in enumerate(y)], "y double, g string")
    model, profile = Glm("poisson", [Categorical("g")]).estimate_theta(df, "y")
    assert 2.2 < profile.value < 4.2 and model.family.name == "negative_binomial"
    z = families.simulate(families.Tweedie(1.5), np.full(2000, 2.0), 1.0, 1.0, rng)
    df = spark.createDataFrame([(float(v), "AB"[i % 2]) for i, v in enumerate(z)], "y double, g string")
    _, profile = Glm(families.tweedie(1.5), [Categorical("g")]).estimate_p(df, "y", method="grid", grid=7)
    assert 1.3 < profile.value < 1.7 and len(profile.trace) == 7


def test_save_load_and_stream(spark, data, tmp_path):
    model = Glm("poisson", [Spline("age", n_knots=5), Categorical("region"), Interaction(Numeric("density"), Categorical("region"))]).fit(data, "y")
    store.save(model, spark, f"file://{tmp_path}/m")
    again = store.load(spark, f"file://{tmp_path}/m")
    a, b = (m.predict(data, name="mu").agg(F.sum("mu")).first()[0] for m in (model, again))
    assert a == pytest.approx(b)
    data.withColumn("ts", F.timestamp_seconds(F.col("fold") * 3600)).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = score.write_stream(score.score_stream(stream, again, name="mu"), f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("mu")).first()[0] == pytest.approx(a)
    q = score.drift(stream, again, "y", "ts").writeStream.format("memory").queryName("drift").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select * from drift").count() == 4


@pytest.mark.parametrize(("strategy", "alpha"), [("quantile", 0.0), ("quantile_tempered", 0.7)])
def test_knots_of_many_distinct_values_weigh_values_by_count(spark, strategy, alpha):
    often, once = np.arange(2000) / 100.0, 1000.0 + np.arange(199_500)
    x = F.when(F.col("id") < 40_000, (F.col("id") % 2000) / 100.0).otherwise(F.col("id") - 39_000.0)
    df = spark.range(239_500).select(x.alias("x"))
    got = Spline("x", n_knots=5, knot_strategy=strategy, knot_alpha=alpha).learned(Stats(df, "x")).interior()
    want = splines.quantile_knots(np.concatenate([often, once]), [20] * 2000 + [1] * 199_500, 5, alpha)
    assert np.allclose(got, want, rtol=1e-9)


def test_profiles_and_null_models(data, spark):
    spec = Glm("poisson", [Categorical("region")])
    _, profile = spec.estimate_theta(data, "y")
    lo, hi = spec.profile_interval(data, "y", profile)
    assert 0.1 <= lo < profile.value < hi <= 50.0
    rates = data.withColumn("log_w", F.log("w"))
    m = spec.fit(rates, "y", offset="log_w")
    row = m.metrics(rates, "y", offset="log_w").first()
    total = rates.agg((F.sum("y") / F.sum("w")).alias("r")).first()["r"]
    want = rates.agg(F.sum(families.poisson().deviance(F.col("y"), F.lit(total) * F.col("w")))).first()[0]
    assert abs(row["null_deviance"] - want) < 1e-5 * want
    aggregate = data.withColumn("z", F.col("y") / 10)
    _, by_mle = Glm(families.tweedie(1.5), [Categorical("region")]).estimate_p(aggregate, "z", method="grid", grid=2, phi_method="mle")
    _, by_pearson = Glm(families.tweedie(1.5), [Categorical("region")]).estimate_p(aggregate, "z", method="grid", grid=2)
    assert all(a["nll"] <= b["nll"] + 1e-6 for a, b in zip(by_mle.trace, by_pearson.trace))


def test_own_scorer(data):
    def absolute(scored, model, y, weight):
        return scored.agg(F.avg(F.abs(F.col(y) - F.col("__mu")))).first()[0]

    cv = select.cross_validate(Glm("poisson", [Categorical("region")]), data, "y", "fold", scoring=("deviance", absolute))
    assert cv.scores.count() == 2 and cv.folds.filter("absolute > 0").count() == 4

