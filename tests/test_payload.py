import numpy as np
import pytest
from pyspark.sql import functions as F

from premia.estimators import Classifier, Regressor
from premia.model import Glm
from premia.operators import payload
from premia.operators.terms import Categorical, Spline, TensorInteraction


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 600
    a, b, r = rng.uniform(0, 10, n), rng.uniform(0, 5, n), rng.choice(["u", "v"], n)
    y = rng.poisson(np.exp(0.2 + 0.1 * a))
    return spark.createDataFrame([(float(i), float(j), str(k), float(v), 1.0 + int(i) % 2) for i, j, k, v in zip(a, b, r, y)], "a double, b double, r string, y double, w double").cache()


def test_payloads(spark, data):
    a, b = Spline("a", n_knots=4), Spline("b", n_knots=3)
    t = TensorInteraction(a, b)
    model = Glm("poisson", [a, b, Categorical("r"), t]).fit(data, "y", "w")
    main = payload.main_effect(model, data, "a", "w", 50, bases=True)
    d = main["density"].toPandas()
    assert np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=0.1) and main["knots"].count() == 6 and main["bases"].count() > 50
    assert payload.main_effect(model, data, "r")["density"].count() == 2
    surface = payload.interaction(model, data, t.name, "w")
    assert surface["surface"].count() == 900 and surface["density"].agg(F.max("hdr_mass")).first()[0] == pytest.approx(1)
    assert payload.compare_terms({"x": model, "z": model}, "a", spark, 20).count() == 40
    ends = payload.extreme_weights(model, data, "w")
    assert ends.count() == 10 and ends.filter("end = 'top'").agg(F.min("working_weight")).first()[0] >= ends.filter("end = 'bottom'").agg(F.max("working_weight")).first()[0]
    panels = payload.diagnostic_panels(model, data, "y", "w", n_sim=20, max_points=200)
    qq = panels["qq"].toPandas()
    assert set(panels) == {"calibration", "qq", "residuals", "leverage"} and ((qq["observed"] >= qq["lower"] - 0.5) & (qq["observed"] <= qq["upper"] + 0.5)).mean() > 0.9


def test_panels_hold_all_rows(data):
    model = Glm("poisson", [Spline("a", n_knots=4)]).fit(data, "y", "w")
    panels = payload.diagnostic_panels(model, data, "y", "w", n_sim=5, max_points=50)
    rows = model.influence(data, "y", "w").agg(F.max("cooks_distance"), F.max("leverage")).first()
    assert [panels[k].agg(F.sum("n")).first()[0] for k in ("residuals", "leverage")] == [600, 600]
    assert panels["leverage"].agg(F.max("cooks_distance")).first()[0] == pytest.approx(rows[0])
    assert panels["leverage"].filter("n = 1").count() >= 50 and panels["qq"].count() == 50


def test_lowess_follows_a_line():
    x = np.linspace(0, 1, 60)
    y = 2 * x + np.random.default_rng(0).normal(scale=0.05, size=60)
    y[30] = 5
    assert np.abs(payload.lowess(x, y, steps=4) - 2 * x).max() < 0.15


def test_estimators(data):
    r = Regressor(spline_features=["a"], categorical_features=["r"]).fit(data, "y", "w")
    assert r.predict(data).filter("prediction > 0").count() == data.count()
    assert Regressor(spline_features=["a"], reml=True).fit(data.drop("w"), "y").model.design.size > 3
    bin_ = data.withColumn("z", (F.col("y") > 2).cast("double")).drop("y", "w")
    c = Classifier(numeric_features=["a"]).fit(bin_, "z")
    assert c.predict_proba(bin_).agg(F.max("probability")).first()[0] <= 1
    assert c.predict(bin_).select("prediction").distinct().count() == 2 and c.decision_function(bin_).agg(F.min("decision")).first()[0] < 0
    with pytest.raises(RuntimeError):
        Regressor().predict(data)
