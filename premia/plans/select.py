"""Model selection: cross-validation over a fold column."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.model import Glm, Model
from premia.operators import adequacy, charts


def score_deviance(scored: DataFrame, model: Model, y: str, weight: str | None) -> tuple[float, float]:
    """(sum, total weight) of the unit deviance."""
    w = adequacy._w(weight)
    r = scored.agg(F.sum(w * model.family.deviance(F.col(f"`{y}`").cast("double"), F.col("__mu"))).alias("d"), F.sum(w).alias("w")).first()
    return r["d"], r["w"]


def score_nll(scored: DataFrame, model: Model, y: str, weight: str | None) -> tuple[float, float]:
    """(negative log-likelihood, rows)."""
    return -adequacy.log_likelihood(scored, y, "__mu", model.family, weight, model.fit.phi), float(scored.count())


def score_gini(scored: DataFrame, model: Model, y: str, weight: str | None) -> tuple[float, float]:
    return charts.gini_cv(scored, y, "__mu", weight).first()[0], 1.0


SCORERS: dict[str, Callable] = {"deviance": score_deviance, "nll": score_nll, "gini": score_gini}


def scorer(metric: str | Callable) -> tuple[str, Callable]:
    """(name, function) of a named metric, or of a function of (scored rows with __mu, model, response, weight) that
    gives a number or a (sum, weight) pair. Such a function aggregates in Spark, with its own UDAF if it likes."""
    if not callable(metric):
        return metric, SCORERS[metric]

    def run(scored: DataFrame, model: Model, y: str, weight: str | None) -> tuple[float, float]:
        got = metric(scored, model, y, weight)
        return (float(got[0]), float(got[1])) if isinstance(got, tuple) else (float(got), 1.0)

    return getattr(metric, "__name__", "score"), run


@dataclass(frozen=True)
class CrossValidation:
    """folds: one row for each fold; scores: mean, std (over all folds) and pooled for each metric; oof, if asked."""

    folds: DataFrame
    scores: DataFrame
    oof: DataFrame | None
    models: list[Model]


def cross_validate(spec: Glm, df: DataFrame, y: str, fold: str, weight: str | None = None, offset=None, *, fit_mode: str = "fit", scoring: Sequence[str | Callable] = ("deviance",), oof: bool = False, error_score: float | str = "raise") -> CrossValidation:
    """Fit on all folds but one, score on that one. Fold values are few and collected; rows are not."""
    spark = df.sparkSession
    scorers = dict(scorer(m) for m in scoring)
    scoring = list(scorers)
    needed = dict.fromkeys([*(c for t in spec.terms for c in t.columns), y, fold, *([weight] if weight else []), *([offset] if isinstance(offset, str) else offset or [])])
    df = (df if oof or set(scorers) - set(SCORERS) else df.select(*(F.col(f"`{c}`") for c in needed))).persist()  # every fold reads it
    values = sorted(r[0] for r in df.select(fold).distinct().limit(1001).collect())
    if not 2 <= len(values) <= 1000:
        raise ValueError("the fold column needs 2 to 1000 values")
    rows, models, parts, sums = [], [], [], {m: [] for m in scoring}
    for v in values:
        train, test = df.filter(F.col(fold) != v), df.filter(F.col(fold) == v)
        began = time.time()
        try:
            model = getattr(spec, "fit_reml" if fit_mode == "fit_reml" else "fit")(train, y, weight, offset)
        except Exception:
            if error_score == "raise":
                raise
            rows.append((str(v), train.count(), test.count(), time.time() - began, 0.0, False, 0, float("nan"), *[float(error_score)] * len(scoring)))
            continue
        fitted = time.time()
        scored = model.predict(test, offset, "__mu")
        got = []
        for m in scoring:
            a, b = scorers[m](scored, model, y, weight)
            sums[m].append((a, b))
            got.append(a / b)
        rows.append((str(v), model.fit.n, test.count(), fitted - began, time.time() - fitted, model.fit.converged, model.fit.n_iter, model.fit.edf, *got))
        models.append(model)
        if oof:
            parts.append(scored.withColumnRenamed("__mu", "oof_prediction"))
    folds = spark.createDataFrame(rows, "fold string, n_train long, n_test long, fit_time_s double, score_time_s double, converged boolean, n_iter int, effective_df double" + "".join(f", `{m}` double" for m in scoring))
    table = []
    for i, m in enumerate(scoring):
        x = [r[8 + i] for r in rows]
        mean = sum(x) / len(x)
        pooled = sum(a for a, _ in sums[m]) / sum(b for _, b in sums[m]) if m != "gini" and sums[m] else None
        table.append((m, mean, (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5, pooled))
    if not oof:
        df.unpersist()
    whole = parts[0] if parts else None
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return CrossValidation(folds, spark.createDataFrame(table, "metric string, mean double, std double, pooled double"), whole, models)


def curve_similarity(models: Sequence[Model], name: str, n_points: int = 200) -> list[dict]:
    """Pairwise root mean square, largest difference and correlation of one term's curves."""
    import numpy as np

    curves = [np.array([r["log_relativity"] for r in m.term_curve(name, n_points=n_points)]) for m in models]
    out = []
    for i in range(len(curves)):
        for j in range(i + 1, len(curves)):
            if len(curves[i]) == len(curves[j]):
                d = curves[i] - curves[j]
                out.append({"a": i, "b": j, "rmse": float(np.sqrt((d**2).mean())), "max_diff": float(np.abs(d).max()), "corr": float(np.corrcoef(curves[i], curves[j])[0, 1]) if len(d) > 1 else float("nan")})
    return out
