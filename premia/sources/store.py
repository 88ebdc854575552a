"""Reading tables, and keeping fitted models as JSON with their coefficients as Parquet."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from premia.functions import families, links
from premia.model import Glm, Model
from premia.operators import terms
from premia.operators.frame import Design
from premia.plans.solve import Fit, GroupPenalty

_KINDS = {c.__name__: c for c in (terms.Numeric, terms.Polynomial, terms.Categorical, terms.Spline, terms.OrderedCategorical, terms.Interaction, terms.LambdaPolicy, terms.ConstraintSpec, terms.LevelGrouping, GroupPenalty, Fit)}


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Any source Spark reads."""
    return spark.read.format(format).options(**options).load(path)


def _out(x):
    if dataclasses.is_dataclass(x):
        return {"__type": type(x).__name__, **{f.name: _out(getattr(x, f.name)) for f in dataclasses.fields(x)}}
    if isinstance(x, np.ndarray):
        return {"array": x.tolist()}
    if isinstance(x, tuple | list):
        return {"tuple": [_out(v) for v in x]}
    if isinstance(x, dict):
        return {"map": [[k, _out(v)] for k, v in x.items()]}
    return x.item() if isinstance(x, np.generic) else x


def _in(x):
    if not isinstance(x, dict):
        return x
    if "array" in x:
        return np.array(x["array"], float)
    if "tuple" in x:
        return tuple(_in(v) for v in x["tuple"])
    if "map" in x:
        return {k: _in(v) for k, v in x["map"]}
    return _KINDS[x["__type"]](**{k: _in(v) for k, v in x.items() if k != "__type"})


def save(model: Model, spark: SparkSession, path: str) -> None:
    """`path`/model: one JSON line; `path`/coefficients: a Parquet table of term, idx, value."""
    f = model.family
    data = {
        "family": [f.name, getattr(f, "theta", getattr(f, "p", None))], "link": [model.link.name, getattr(model.link, "power", getattr(model.link, "theta", None))],
        "terms": [_out(t) for t in model.design.terms], "penalty": _out(model.spec.penalty), "fit": _out(model.fit), "info": model.info, "has_offset": model.has_offset,
        "settings": {k: getattr(model.spec, k) for k in ("spline_penalty", "tol", "max_iter", "convergence")},
    }
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
    rows = [("(intercept)", 0, model.fit.intercept)] + [(t.name, i, float(b)) for t in model.design.terms for i, b in enumerate(model.beta(t.name))]
    spark.createDataFrame(rows, "term string, idx int, value double").coalesce(1).write.mode("overwrite").parquet(f"{path}/coefficients")


def load(spark: SparkSession, path: str) -> Model:
    data = json.loads(spark.read.text(f"{path}/model").first()[0])
    name, value = data["family"]
    family = families.NegativeBinomial(value) if name == "negative_binomial" else families.Tweedie(value) if name == "tweedie" else families.resolve(name)
    link, power = data["link"]
    chosen = links.Power(power) if link.startswith("power") else links.NegativeBinomialLink(power) if link.startswith("nb") else links.NAMED[link]()
    fitted = tuple(_in(t) for t in data["terms"])
    fit = _in(data["fit"])
    fit.trace = list(fit.trace)
    return Model(Glm(family, fitted, chosen, _in(data["penalty"]), **data["settings"]), Design(fitted), fit, data["info"], data["has_offset"])
