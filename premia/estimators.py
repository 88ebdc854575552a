"""Estimators with lists of column names: a regressor and a classifier over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.families import Family
from premia.model import Glm, Model
from premia.operators.terms import Categorical, Numeric, Spline, Term, detect
from premia.plans.solve import GroupPenalty


@dataclass
class Regressor:
    """Terms from lists of columns; columns that are in none are detected by type, unless lists are given."""

    family: str | Family = "poisson"
    link: str | None = None
    penalty: GroupPenalty | None = None
    features: Sequence[Term] | None = None
    spline_features: Sequence[str] = ()
    categorical_features: Sequence[str] = ()
    numeric_features: Sequence[str] = ()
    offset: str | Sequence[str] | None = None
    n_knots: int = 10
    spline_penalty: float = 0.1
    reml: bool = False
    model: Model | None = field(default=None, init=False)

    def _terms(self, df: DataFrame, y: str, weight: str | None) -> list[Term]:
        if self.features is not None:
            return list(self.features)
        if self.categorical_features or self.numeric_features:
            return [*(Spline(c, n_knots=self.n_knots) for c in self.spline_features), *map(Categorical, self.categorical_features), *map(Numeric, self.numeric_features)]
        offsets = [self.offset] if isinstance(self.offset, str) else list(self.offset or [])
        return detect(df, self.spline_features, self.n_knots, [y, *([weight] if weight else []), *offsets])

    def fit(self, df: DataFrame, y: str, weight: str | None = None) -> Regressor:
        spec = Glm(self.family, self._terms(df, y, weight), self.link, self.penalty, self.spline_penalty)
        self.model = (spec.fit_reml if self.reml else spec.fit)(df, y, weight, self.offset)
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit first")
        return self.model.predict(df, self.offset, name)


@dataclass
class Classifier(Regressor):
    """Binomial regressor with probabilities, a threshold and an unclipped decision function."""

    family: str | Family = "binomial"
    threshold: float = 0.5

    def predict_proba(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return super().predict(df, name)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return super().predict(df, "__p").withColumn(name, (F.col("__p") >= self.threshold).cast("int")).drop("__p")

    def decision_function(self, df: DataFrame, name: str = "decision") -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit first")
        return df.withColumn(name, self.model.eta(self.offset))
