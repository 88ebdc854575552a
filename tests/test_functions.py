import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.functions import families, links, special
from premia.operators import splines

FAMILIES = [families.Poisson(), families.Gaussian(), families.Gamma(), families.NegativeBinomial(2.0), families.Tweedie(1.4), families.Binomial()]


def test_tails_and_quantiles():
    assert special.norm_ppf(0.975) == pytest.approx(1.959963984540054, abs=1e-12)
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert special.t_sf(2.228138851964939, 10) == pytest.approx(0.025, abs=1e-10)
    assert special.f_sf(special.norm_ppf(0.975) ** 2, 1, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-10)
    assert special.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-10)
    assert special.chi2_mix_sf(5.991464547107979, [1, 1]) == pytest.approx(0.05, abs=1e-4)
    assert special.satterthwaite_sf(5.991464547107979, [1, 1]) == pytest.approx(0.05, abs=1e-9)


def test_isotonic_is_least_squares():
    rng = np.random.default_rng(0)
    y, w = rng.normal(size=30) + np.linspace(0, 1, 30), rng.random(30) + 0.1
    fit = special.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    for _ in range(200):
        other = np.sort(fit + rng.normal(scale=0.1, size=30))
        assert (w * (y - fit) ** 2).sum() <= (w * (y - other) ** 2).sum() + 1e-9


@pytest.mark.parametrize("p", [1.2, 1.5, 1.8])
def test_tweedie_density_sums_to_one(p):
    y = np.concatenate([np.geomspace(1e-9, 1e-2, 4000), np.linspace(1e-2, 80, 40_000)[1:]])
    mass = np.trapezoid(np.exp(special.tweedie_logpdf(y, 2.0, 1.0, p)), y) + math.exp(special.tweedie_logpdf(np.array([0.0]), 2.0, 1.0, p)[0])
    assert mass == pytest.approx(1.0, abs=2e-3)


@pytest.mark.parametrize("family", FAMILIES, ids=lambda f: f.name)
def test_deviance_is_zero_at_the_response_and_its_slope_is_the_score(family):
    y = np.array([0.3, 0.7]) if family.name == "binomial" else np.array([0.5, 3.0])
    if family.name != "binomial":
        assert np.allclose(family.deviance(y, y), 0, atol=1e-10)
    m, h = np.array([0.4, 0.6]), 1e-6
    slope = (family.deviance(y, m + h) - family.deviance(y, m - h)) / (2 * h)
    assert np.allclose(slope, -2 * (y - m) / family.variance(m), atol=1e-5)
    assert np.allclose((family.variance(m + h) - family.variance(m - h)) / (2 * h), family.variance_derivative(m), atol=1e-6)


def test_nb2_deviance_at_zero_is_positive():
    assert families.NegativeBinomial(2.0).deviance(np.array([0.0]), np.array([1.0]))[0] == pytest.approx(4 * math.log(1.5))


@pytest.mark.parametrize("name", sorted(links.NAMED))
def test_links_invert_and_differentiate(name):
    link = links.NAMED[name]()
    mu = np.array([0.2, 0.5, 0.8])
    eta, h = link.link(mu), 1e-5
    assert np.allclose(link.inverse(eta), mu)
    assert np.allclose((link.inverse(eta + h) - link.inverse(eta - h)) / (2 * h), link.deriv_inverse(eta), rtol=1e-5)
    assert np.allclose((link.deriv_inverse(eta + h) - link.deriv_inverse(eta - h)) / (2 * h), link.deriv2_inverse(eta), rtol=1e-4, atol=1e-8)
    assert np.allclose((link.deriv2_inverse(eta + h) - link.deriv2_inverse(eta - h)) / (2 * h), link.deriv3_inverse(eta), rtol=1e-3, atol=1e-4)


def test_columns_agree_with_arrays(spark):
    y, m = np.array([0.0, 1.0, 4.0]), np.array([0.5, 2.0, 3.0])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, m)], "y double, m double")
    for family in FAMILIES[:2] + FAMILIES[3:5]:
        got = [r[0] for r in df.select(family.deviance(F.col("y"), F.col("m"))).collect()]
        assert np.allclose(got, family.deviance(y, m))
    got = [r[0] for r in df.select(families.Poisson().log_likelihood(F.col("y"), F.col("m"), F.lit(1.0))).collect()]
    assert np.allclose(got, families.Poisson().log_likelihood(y, m, 1.0), atol=1e-9)
    got = [r[0] for r in df.select(links.Probit().inverse(F.col("m") - 1)).collect()]
    assert np.allclose(got, special.norm_cdf(m - 1), atol=1e-7)


def test_simulated_means():
    rng = np.random.default_rng(1)
    for family in FAMILIES:
        mu = np.full(20_000, 0.4)
        assert families.simulate(family, mu, 0.5, 1.0, rng).mean() == pytest.approx(0.4, abs=0.03)


def test_bsplines_and_penalties():
    k = splines.open_knots(splines.uniform_knots(0, 1, 5), 0, 1, 3)
    x = np.linspace(0, 1, 50)
    b = splines.bspline_basis(x, k, 3)
    assert np.allclose(b.sum(axis=1), 1) and (b >= 0).all()
    line = np.linalg.lstsq(b, x, rcond=None)[0]
    assert np.allclose(b @ line, x) and abs(line @ splines.derivative_penalty(k, 3, 2) @ line) < 1e-8
    second, penalty = splines.cardinal_system(np.linspace(0, 1, 6))
    assert np.allclose(splines.cardinal_basis(np.linspace(0, 1, 6), np.linspace(0, 1, 6), second), np.eye(6))
    assert np.linalg.matrix_rank(penalty, tol=1e-8) == 4


def test_qp_matches_projection():
    rng = np.random.default_rng(2)
    for _ in range(20):
        y = rng.normal(size=8)
        got = splines.solve_qp(np.eye(8), y, splines.monotone_rows(8, "increasing"), np.zeros(7))
        assert np.allclose(got, special.isotonic(y), atol=1e-6)


def test_incomplete_functions_over_arrays():
    rng = np.random.default_rng(1)
    a, b, x = rng.uniform(0.2, 60, 300), rng.uniform(0.2, 60, 300), rng.uniform(0, 90, 300)
    x[:5] = 0
    assert np.allclose(special.gammainc(a, x), [special.gammainc_lower(k, v) for k, v in zip(a, x)], atol=1e-12)
    u = np.concatenate([[0.0, 1.0], rng.random(298)])
    assert np.allclose(special.betaincs(a, b, u), [special.betainc(k, m, v) for k, m, v in zip(a, b, u)], atol=1e-11)

