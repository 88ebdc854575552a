"""Model terms: what each learns from the data, its basis over arrays, and its score as one Spark column.

A term is a small immutable description. `needs` lists the statistics it must learn; `learned` returns a fitted copy.
`raw` gives the basis over arrays; a fitted term's `transform` turns raw into solver columns (centred, scaled), and
`penalties` are the quadratic penalties in solver coordinates. `effect` is the score as a column expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.operators import charts, splines


@dataclass(frozen=True)
class LambdaPolicy:
    """How a smoothing parameter is set: estimate, fixed(value) or off."""

    mode: str = "estimate"
    value: float | None = None

    @staticmethod
    def estimate() -> LambdaPolicy:
        return LambdaPolicy()

    @staticmethod
    def fixed(value: float) -> LambdaPolicy:
        return LambdaPolicy("fixed", value)

    @staticmethod
    def off() -> LambdaPolicy:
        return LambdaPolicy("off", 0.0)


@dataclass(frozen=True)
class ConstraintSpec:
    """When a shape is imposed (fit, postfit) and which (increasing, decreasing, convex, concave)."""

    mode: str
    kind: str


class _Kinds:
    def __init__(self, mode: str):
        self.increasing, self.decreasing = ConstraintSpec(mode, "increasing"), ConstraintSpec(mode, "decreasing")
        self.convex, self.concave = ConstraintSpec(mode, "convex"), ConstraintSpec(mode, "concave")


class Constraint:
    fit, postfit = _Kinds("fit"), _Kinds("postfit")


@dataclass(frozen=True)
class LevelGrouping:
    """Original levels mapped to group labels."""

    mapping: Mapping[str, str]

    def column(self, c: Column) -> Column:
        pairs = F.create_map(*(F.lit(x) for kv in self.mapping.items() for x in kv))
        return F.coalesce(pairs[c], c)

    def array(self, x) -> np.ndarray:
        return np.array([self.mapping.get(str(v), str(v)) for v in x], object)


def collapse_levels(levels: Sequence[str], *, from_level: str | None = None, below: str | None = None, groups: Mapping[str, Sequence[str]] | None = None) -> LevelGrouping:
    """A grouping of ordered levels: the tail from a level, the head below one, or explicit groups (just one of them)."""
    if sum(x is not None for x in (from_level, below, groups)) != 1:
        raise ValueError("give just one of from_level, below and groups")
    levels = [str(x) for x in levels]
    if groups is None:
        at = from_level if from_level is not None else below
        if str(at) not in levels:
            raise ValueError(f"{at!r} is not a level")
        i = levels.index(str(at))
        members = levels[i:] if from_level is not None else levels[:i]
        groups = {f"{members[0]}+" if from_level is not None else f"<{at}": members} if members else {}
    seen: dict[str, str] = {}
    for label, members in groups.items():
        for m in map(str, members):
            if m not in levels or m in seen:
                raise ValueError(f"{m!r} is not a level, or is in two groups")
            seen[m] = str(label)
    return LevelGrouping({x: seen.get(x, x) for x in levels})


@dataclass(frozen=True)
class Penalty:
    """One quadratic penalty in a term's solver coordinates."""

    name: str
    matrix: np.ndarray
    policy: LambdaPolicy = LambdaPolicy()


class Term:
    """Base of all terms. `columns` are the data columns it reads."""

    name: str
    columns: tuple[str, ...]

    def learned(self, stats: Stats) -> Term:
        return self

    @property
    def size(self) -> int:
        raise NotImplementedError

    def raw(self, data: Mapping[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def design(self, data: Mapping[str, np.ndarray]) -> np.ndarray:
        return self.raw(data)

    def finished(self, sums: np.ndarray, gram: np.ndarray, total: float, lam: float) -> Term:
        """With the unweighted column sums and weighted Gram of raw: centre and scale. Plain terms need neither."""
        return self

    def penalties(self) -> list[Penalty]:
        return []

    def effect(self, beta: np.ndarray) -> Column:
        raise NotImplementedError

    def key(self) -> list[Column] | None:
        """Columns whose distinct values determine the term; None if there are too many to group by."""
        return None


class Stats:
    """What terms learn from the data, all gathered by a few aggregations."""

    def __init__(self, df: DataFrame, weight: str):
        self.df, self.weight, self._ranges = df, weight, {}

    def ranges(self, columns: Sequence[str]) -> None:
        new = [c for c in dict.fromkeys(columns) if c not in self._ranges]
        if new:
            aggs = [f(F.col(f"`{c}`").cast("double")).alias(f"{k}{i}") for i, c in enumerate(new) for k, f in (("lo", F.min), ("hi", F.max))]
            bad = [F.sum(F.when(F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double")), 1).otherwise(0)).alias(f"bad{i}") for i, c in enumerate(new)]
            row = self.df.agg(*aggs, *bad).first()
            for i, c in enumerate(new):
                if row[f"bad{i}"]:
                    raise ValueError(f"column {c!r} has {row[f'bad{i}']} missing values")
                self._ranges[c] = (row[f"lo{i}"], row[f"hi{i}"])

    def range(self, column: str) -> tuple[float, float]:
        self.ranges([column])
        return self._ranges[column]

    def levels(self, column: Column, name: str, limit: int = 10_000) -> list[tuple[str, float, int]]:
        """(level, weight, rows) in binary order; more than `limit` levels are an error."""
        rows = self.df.select(column.cast("string").alias("l"), F.col(self.weight).alias("w")).groupBy("l").agg(F.sum("w").alias("w"), F.count("*").alias("n")).limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{name!r} has more than {limit} levels")
        if any(r["l"] is None for r in rows):
            raise ValueError(f"{name!r} has missing values")
        return sorted(((r["l"], r["w"], r["n"]) for r in rows), key=lambda r: r[0].encode())

    def support(self, column: str, limit: int) -> list[tuple[float, int]] | None:
        """Distinct values and their counts, or None if there are more than `limit`."""
        rows = self.df.groupBy(F.col(f"`{column}`").cast("double").alias("x")).count().limit(limit + 1).collect()
        return None if len(rows) > limit else sorted((r["x"], r["count"]) for r in rows)

    def value_quantiles(self, column: str, n: int, alpha: float) -> np.ndarray:
        """splines.quantile_knots over all distinct values, in Spark: the rows around each target are interpolated."""
        x = F.col(f"`{column}`").cast("double").alias("x")
        rows = charts.running(self.df.groupBy(x).count().withColumn("w", F.pow("count", F.lit(float(alpha)))), [F.col("x")], {"cum": F.col("w")})
        at = rows.select("x", ((F.col("cum") - 0.5 * F.col("w")) / F.col("cum__all")).alias("at"))
        key, targets = F.struct("at", "x"), [i / (n + 1) for i in range(1, n + 1)]
        got = at.agg(*(F.max(F.when(F.col("at") <= t, key)).alias(f"a{i}") for i, t in enumerate(targets)), *(F.min(F.when(F.col("at") > t, key)).alias(f"b{i}") for i, t in enumerate(targets))).first()
        around = [(got[f"a{i}"] or got[f"b{i}"], got[f"b{i}"] or got[f"a{i}"]) for i in range(n)]
        return np.array([np.interp(t, [a["at"], b["at"]], [a["x"], b["x"]]) for t, (a, b) in zip(targets, around, strict=True)])

    def quantiles(self, column: str, probabilities: Sequence[float]) -> list[float]:
        return list(self.df.agg(F.percentile_approx(F.col(f"`{column}`").cast("double"), list(probabilities), 100_000)).first()[0])


def _num(data: Mapping[str, np.ndarray], c: str) -> np.ndarray:
    return np.asarray(data[c], float)


@dataclass(frozen=True)
class Numeric(Term):
    """The column itself."""

    column: str

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self):
        return (self.column,)

    size = 1

    def learned(self, stats: Stats) -> Term:
        stats.range(self.column)
        return self

    def raw(self, data):
        return _num(data, self.column)[:, None]

    def effect(self, beta):
        return F.col(f"`{self.column}`").cast("double") * float(beta[0])


def legendre_powers(degree: int) -> np.ndarray:
    """Power coefficients of the Legendre polynomials of degree 1 to `degree` (rows)."""
    out = np.zeros((degree, degree + 1))
    for d in range(1, degree + 1):
        out[d - 1, : d + 1] = np.polynomial.legendre.leg2poly([0] * d + [1])
    return out


def horner(z: Column, powers: Sequence[float]) -> Column:
    """A polynomial as a column; powers ascending."""
    out = F.lit(float(powers[-1]))
    for p in reversed(list(powers[:-1])):
        out = out * z + float(p)
    return out


@dataclass(frozen=True)
class Polynomial(Term):
    """Legendre polynomials of degree 1 to `degree` on the training range scaled to [-1, 1]."""

    column: str
    degree: int = 3
    lo: float | None = None
    hi: float | None = None

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self):
        return (self.column,)

    @property
    def size(self) -> int:
        return self.degree

    def learned(self, stats: Stats) -> Term:
        lo, hi = stats.range(self.column)
        return replace(self, lo=lo, hi=hi if hi > lo else lo + 1)

    def raw(self, data):
        z = 2 * (_num(data, self.column) - self.lo) / (self.hi - self.lo) - 1
        return np.polynomial.legendre.legvander(z, self.degree)[:, 1:]

    def effect(self, beta):
        z = 2 * (F.col(f"`{self.column}`").cast("double") - self.lo) / (self.hi - self.lo) - 1
        return horner(z, beta @ legendre_powers(self.degree))


def unseen(c: Column, levels: Sequence[str], name: str, then: Column) -> Column:
    """`then`, but an error for a missing or unseen level."""
    return F.when(c.isNull() | ~c.isin(list(levels)), F.raise_error(F.concat(F.lit(f"{name}: unknown level "), F.coalesce(c, F.lit("null"))))).otherwise(then)


@dataclass(frozen=True)
class Categorical(Term):
    """One indicator for each level but the base: the most exposed, the first, or a named one."""

    column: str
    base: str = "most_exposed"
    grouping: LevelGrouping | None = None
    levels: tuple[str, ...] = ()
    base_level: str | None = None
    weights: tuple[float, ...] = ()
    counts: tuple[int, ...] = ()

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self):
        return (self.column,)

    @property
    def size(self) -> int:
        return len(self.levels) - 1

    @property
    def others(self) -> list[str]:
        return [x for x in self.levels if x != self.base_level]

    def value(self) -> Column:
        c = F.col(f"`{self.column}`").cast("string")
        return self.grouping.column(c) if self.grouping else c

    def learned(self, stats: Stats) -> Term:
        found = stats.levels(self.value(), self.column)
        if len(found) < 2:
            raise ValueError(f"{self.column!r} needs two levels at least")
        levels = tuple(x[0] for x in found)
        if self.base == "most_exposed":
            base = max(found, key=lambda r: r[1])[0]
        else:
            base = levels[0] if self.base == "first" else self.base
        if base not in levels:
            raise ValueError(f"base {base!r} is not a level of {self.column!r}")
        return replace(self, levels=levels, base_level=base, weights=tuple(x[1] for x in found), counts=tuple(x[2] for x in found))

    def codes(self, data) -> np.ndarray:
        x = data[self.column]
        x = np.asarray(x)
        if x.dtype == bool or (x.dtype == object and len(x) and isinstance(x[0], bool | np.bool_)):
            x = np.where(x.astype(bool), "true", "false")  # as Spark writes them
        x = self.grouping.array(x) if self.grouping else np.asarray(x, object).astype(str)
        at = np.searchsorted(np.array(self.levels), x)
        if (at >= len(self.levels)).any() or (np.array(self.levels)[np.minimum(at, len(self.levels) - 1)] != x).any():
            raise ValueError(f"{self.column!r} has a level that was not there at fit")
        return at

    def raw(self, data):
        keep = [i for i, x in enumerate(self.levels) if x != self.base_level]
        return (self.codes(data)[:, None] == np.array(keep)[None, :]).astype(float)

    def effect(self, beta):
        c = self.value()
        pairs = F.create_map(*(F.lit(x) for level, b in [(self.base_level, 0.0), *zip(self.others, map(float, beta), strict=True)] for x in (level, b)))
        return unseen(c, self.levels, self.column, pairs[c])

    def key(self):
        return [F.col(f"`{self.column}`").cast("string").alias(self.column)]


_KINDS = ("ps", "bs", "ns", "cr", "cr_cardinal")


def n_knots_from_k(kind: str, k: int, degree: int = 3) -> int:
    """Interior knots of a basis of k functions."""
    least = {"ps": degree + 2, "bs": degree + 2, "cr": degree, "ns": degree, "cr_cardinal": 3}[kind]
    if k < least:
        raise ValueError(f"k must be {least} or more for {kind}")
    return {"ps": k - degree - 1, "bs": k - degree - 1, "cr": k - degree + 1, "ns": k - degree + 1, "cr_cardinal": k - 2}[kind]


@dataclass(frozen=True)
class Spline(Term):
    """A smooth of one column.

    kind: ps (difference penalty), bs (integrated derivative penalty), ns (natural ends, difference penalty), cr
    (natural cubic, integrated second derivative), cr_cardinal (values at knots). `discrete` replaces the column by
    the centres of n_bins equal bins (by its distinct values if there are no more of them). `m`: derivative orders,
    each with a penalty of its own. `select` adds a penalty on what the other leaves free.
    """

    column: str
    kind: str = "ps"
    n_knots: int = 10
    degree: int = 3
    k: int | None = None
    knot_strategy: str = "uniform"
    knot_alpha: float = 0.2
    penalty: str = "ssp"
    select: bool = False
    knots: tuple[float, ...] | None = None
    discrete: bool = False
    n_bins: int = 256
    extrapolation: str = "clip"
    boundary: tuple[float, float] | None = None
    constraint: ConstraintSpec | None = None
    m: tuple[int, ...] = (2,)
    lambda_policy: LambdaPolicy = LambdaPolicy()
    lo: float | None = None
    hi: float | None = None
    vector: tuple[float, ...] = ()
    support: tuple[float, ...] | None = None
    transform: np.ndarray | None = field(default=None, compare=False)
    omegas: tuple[np.ndarray, ...] = field(default=(), compare=False)

    def __post_init__(self):
        if self.kind not in _KINDS:
            raise ValueError(f"kind must be one of {', '.join(_KINDS)}")
        if self.extrapolation not in ("clip", "extend", "error"):
            raise ValueError("extrapolation must be clip, extend or error")
        if self.constraint and self.constraint.kind in ("increasing", "decreasing") and self.kind == "ns":
            raise ValueError("no monotone fit for natural splines")
        if self.kind in ("cr", "cr_cardinal") and self.degree != 3:
            raise ValueError("cubic regression splines have degree 3")

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self):
        return (self.column,)

    @property
    def size(self) -> int:
        return self.transform.shape[1] if self.transform is not None else self.raw_size

    @property
    def raw_size(self) -> int:
        return len(self.vector) if self.kind == "cr_cardinal" else len(self.vector) - self.degree - 1

    @property
    def scop(self) -> bool:
        """Is the term fitted monotone, with coefficients that are exponentials?"""
        return bool(self.constraint and self.constraint.mode == "fit" and self.constraint.kind in ("increasing", "decreasing") and self.kind in ("ps", "bs"))

    def learned(self, stats: Stats) -> Term:
        lo, hi = self.boundary or stats.range(self.column)
        if not hi > lo:
            raise ValueError(f"{self.column!r} is constant")
        n = n_knots_from_k(self.kind, self.k, self.degree) if self.k else self.n_knots
        support = stats.support(self.column, self.n_bins) if self.discrete else None
        if self.knots is not None:
            inner = np.array(sorted(self.knots), float)
        elif self.knot_strategy == "uniform":
            inner = splines.uniform_knots(lo, hi, n)
        elif self.knot_strategy == "quantile_rows":
            inner = np.array(stats.quantiles(self.column, [i / (n + 1) for i in range(1, n + 1)]))
        else:  # quantiles of distinct values, rows weighing count ** alpha
            found = support and [(x, c) for x, c in support] or stats.support(self.column, 200_000)
            alpha = self.knot_alpha if self.knot_strategy == "quantile_tempered" else 0.0
            inner = splines.quantile_knots([x for x, _ in found], [c for _, c in found], n, alpha) if found else stats.value_quantiles(self.column, n, alpha)
        if len(np.unique(inner)) < len(inner):
            inner = splines.uniform_knots(lo, hi, len(inner))
        if self.kind == "cr_cardinal":
            vector = np.concatenate([[lo], inner, [hi]])
        elif self.kind in ("ps", "bs"):
            vector = splines.open_knots(inner, lo, hi, self.degree)
        else:
            vector = splines.clamped_knots(inner, lo, hi, self.degree, 1e-6 * (hi - lo) if self.kind == "ns" else 0.0)
        return replace(self, lo=float(lo), hi=float(hi), vector=tuple(vector.tolist()), support=tuple(x for x, _ in support) if support else None)

    def interior(self) -> list[float]:
        v = list(self.vector)
        return v[1:-1] if self.kind == "cr_cardinal" else v[self.degree + 1 : len(v) - self.degree - 1]

    def binned(self, x: np.ndarray) -> np.ndarray:
        if not self.discrete or self.support is not None:
            return x
        width = (self.hi - self.lo) / self.n_bins
        return self.lo + (np.clip(np.floor((x - self.lo) / width), 0, self.n_bins - 1) + 0.5) * width

    def basis(self, x) -> np.ndarray:
        x = np.asarray(x, float)
        if self.extrapolation == "error" and ((x < self.lo) | (x > self.hi)).any():
            raise ValueError(f"{self.column!r} lies outside its training range")
        inside = np.clip(x, self.lo, self.hi)
        if self.kind == "cr_cardinal":
            second, _ = splines.cardinal_system(np.array(self.vector))
            at = lambda v: splines.cardinal_basis(v, self.vector, second)
        else:
            at = lambda v: splines.bspline_basis(v, self.vector, self.degree)
        out = at(inside)
        if self.extrapolation == "extend" and (far := x != inside).any():
            h = 1e-5 * (self.hi - self.lo)
            for end, sign in ((self.lo, 1), (self.hi, -1)):
                rows = far & (inside == end)
                slope = (at(np.array([end + sign * h])) - at(np.array([end]))) / (sign * h)
                out[rows] += (x[rows] - end)[:, None] * slope
        return out

    def raw(self, data):
        return self.basis(self.binned(_num(data, self.column)))

    def design(self, data):
        if self.discrete and self.support is None:  # one row of the table for each bin
            width = (self.hi - self.lo) / self.n_bins
            centres = self.lo + (np.arange(self.n_bins) + 0.5) * width
            return (self.basis(centres) @ self.transform)[np.clip(np.floor((_num(data, self.column) - self.lo) / width), 0, self.n_bins - 1).astype(int)]
        return self.raw(data) @ self.transform

    def raw_penalties(self) -> list[np.ndarray]:
        if self.penalty == "none":
            return []
        v = np.array(self.vector)
        if self.kind == "cr_cardinal":
            return [splines.cardinal_system(v)[1]]
        if self.kind in ("ps", "ns"):
            return [splines.difference_penalty(self.raw_size, m) for m in self.m]
        return [splines.derivative_penalty(v, self.degree, m) for m in self.m]

    def finished(self, sums, gram, total, lam):
        if self.scop:
            # running sums of the B-splines from the right, centred; their coefficients are the steps between neighbours
            steps = np.tri(self.raw_size, k=-1)[:, :-1] * (1 if self.constraint.kind == "increasing" else -1)
            steps = steps - (sums / sums.sum()) @ steps
            return replace(self, transform=steps, omegas=(splines.difference_penalty(self.raw_size - 1, 1),) if self.penalty != "none" else ())
        z = np.eye(self.raw_size)
        if self.kind in ("ns", "cr"):
            z = splines.natural_ends(self.vector, self.degree, self.lo, self.hi)
        z = z @ splines.centring(sums @ z)
        raw = [z.T @ p @ z for p in self.raw_penalties()]
        whole = sum(raw) if raw else np.zeros((z.shape[1],) * 2)
        r = splines.whitening(z.T @ gram @ z / total, whole, lam)
        omegas = [r.T @ p @ r for p in raw]
        if self.select and raw:
            values, vectors = np.linalg.eigh(omegas[0])
            free = vectors[:, values < 1e-8 * max(values.max(), 1e-300)]
            omegas.append(free @ free.T)
        return replace(self, transform=z @ r, omegas=tuple(omegas))

    def penalties(self):
        names = [f"{self.name}:m{m}" if len(self.m) > 1 else self.name for m in self.m][: max(1, len(self.omegas))]
        if self.scop:
            names = [self.name]
        elif self.select:
            names = [*names[: len(self.omegas) - 1], f"{self.name}:null"]
        return [Penalty(n, o, self.lambda_policy) for n, o in zip(names, self.omegas, strict=False)]

    def curve(self, x, beta) -> np.ndarray:
        return self.basis(np.clip(np.asarray(x, float), self.lo, self.hi)) @ (self.transform @ beta)

    def effect(self, beta):
        """One polynomial for each knot interval, chosen by a search over the (few) breaks."""
        x = F.col(f"`{self.column}`").cast("double")
        raw = self.transform @ np.asarray(beta, float)
        if self.discrete and self.support is None:
            width = (self.hi - self.lo) / self.n_bins
            x = self.lo + (F.least(F.greatest(F.floor((x - self.lo) / width), F.lit(0)), F.lit(self.n_bins - 1)) + 0.5) * width
        breaks = [self.lo, *(k for k in self.interior() if self.lo < k < self.hi), self.hi]
        value = lambda v: replace(self, extrapolation="clip").basis(v) @ raw
        pieces = []
        for a, b in zip(breaks, breaks[1:], strict=False):
            t = (1 - np.cos(np.pi * (np.arange(self.degree + 1) + 0.5) / (self.degree + 1))) / 2
            powers = np.linalg.solve(np.vander(t, increasing=True), value(a + t * (b - a)))
            pieces.append((a, b, powers))
        inside = F.least(F.greatest(x, F.lit(self.lo)), F.lit(self.hi))
        which = F.lit(0)
        for b in breaks[1:-1]:
            which = which + F.when(inside >= F.lit(b), 1).otherwise(0)
        table = F.array(*(F.array(F.lit(a), F.lit(1 / (b - a)), *(F.lit(float(p)) for p in powers)) for a, b, powers in pieces))
        row = F.element_at(table, which + 1)
        z = (inside - F.element_at(row, 1)) * F.element_at(row, 2)
        out = F.element_at(row, 3 + self.degree)
        for d in range(self.degree - 1, -1, -1):
            out = out * z + F.element_at(row, 3 + d)
        if self.extrapolation == "extend":
            h = 1e-5 * (self.hi - self.lo)
            low = float((value(np.array([self.lo + h])) - value(np.array([self.lo])))[0] / h)
            high = float((value(np.array([self.hi])) - value(np.array([self.hi - h])))[0] / h)
            out = out + F.when(x < self.lo, (x - self.lo) * low).when(x > self.hi, (x - self.hi) * high).otherwise(0.0)
        if self.extrapolation == "error":
            out = F.when((x < self.lo) | (x > self.hi), F.raise_error(F.lit(f"{self.column}: outside the training range"))).otherwise(out)
        return out

    def key(self):
        x = F.col(f"`{self.column}`").cast("double")
        if not self.discrete:
            return None
        if self.support is None:
            width = (self.hi - self.lo) / self.n_bins
            x = self.lo + (F.least(F.greatest(F.floor((x - self.lo) / width), F.lit(0)), F.lit(self.n_bins - 1)) + 0.5) * width
        return [x.alias(self.column)]


def PSpline(column: str, **kw) -> Spline:
    return Spline(column, kind="ps", **kw)


def BSplineSmooth(column: str, **kw) -> Spline:
    return Spline(column, kind="bs", **kw)


def NaturalSpline(column: str, **kw) -> Spline:
    return Spline(column, kind="ns", **kw)


def CubicRegressionSpline(column: str, **kw) -> Spline:
    return Spline(column, kind="cr", **kw)


def CardinalCRSpline(column: str, **kw) -> Spline:
    return Spline(column, kind="cr_cardinal", **kw)


@dataclass(frozen=True)
class OrderedCategorical(Term):
    """Ordered levels: a spline over their positions, or steps (indicators) with a first-difference penalty."""

    column: str
    values: Mapping[str, float] | None = field(default=None, hash=False)
    order: tuple[str, ...] | None = None
    basis: str = "spline"
    base: str = "most_exposed"
    n_knots: int = 5
    kind: str = "ps"
    select: bool = False
    inner: Spline | None = None
    steps: Categorical | None = None
    omega: np.ndarray | None = field(default=None, compare=False)

    @property
    def name(self) -> str:
        return self.column

    @property
    def columns(self):
        return (self.column,)

    @property
    def positions(self) -> dict[str, float]:
        if self.values is not None:
            return {str(k): float(v) for k, v in self.values.items()}
        return {str(k): float(i) for i, k in enumerate(self.order)}

    @property
    def ranked(self) -> list[str]:
        return sorted(self.positions, key=self.positions.get)

    @property
    def size(self) -> int:
        return self.inner.size if self.inner else self.steps.size

    def learned(self, stats: Stats) -> Term:
        if (self.values is None) == (self.order is None):
            raise ValueError("give just one of values and order")
        at = self.positions
        found = stats.levels(F.col(f"`{self.column}`"), self.column)
        if strange := [x for x, _, _ in found if x not in at]:
            raise ValueError(f"{self.column!r} has levels without a place: {strange[:5]}")
        if self.basis == "spline":
            seen = sorted(at[x] for x, _, _ in found)
            spline = Spline(self.column, kind=self.kind, n_knots=max(1, min(self.n_knots, len(seen) - 1)), select=self.select, boundary=(seen[0], seen[-1]))
            return replace(self, inner=spline.learned(stats))
        return replace(self, steps=Categorical(self.column, base=self.base).learned(stats))

    def _at(self, data) -> dict[str, np.ndarray]:
        at = self.positions
        return {self.column: np.array([at[str(v)] for v in data[self.column]], float)}

    def raw(self, data):
        return self.inner.raw(self._at(data)) if self.inner else self.steps.raw(data)

    def design(self, data):
        return self.inner.design(self._at(data)) if self.inner else self.steps.raw(data)

    def finished(self, sums, gram, total, lam):
        if self.inner:
            return replace(self, inner=self.inner.finished(sums, gram, total, lam))
        ranked = [x for x in self.ranked if x in self.steps.levels]
        d = np.diff(np.eye(len(ranked)), axis=0)
        keep = [ranked.index(x) for x in self.steps.others]
        return replace(self, omega=(d.T @ d)[np.ix_(keep, keep)])

    def penalties(self):
        return self.inner.penalties() if self.inner else [Penalty(self.name, self.omega)]

    def effect(self, beta):
        if not self.inner:
            return self.steps.effect(beta)
        c = F.col(f"`{self.column}`").cast("string")
        levels = self.ranked
        fitted = self.inner.curve([self.positions[x] for x in levels], beta)
        pairs = F.create_map(*(F.lit(x) for k, v in zip(levels, fitted.tolist(), strict=True) for x in (k, v)))
        return unseen(c, levels, self.column, pairs[c])

    def key(self):
        return [F.col(f"`{self.column}`").cast("string").alias(self.column)]


@dataclass(frozen=True)
class Interaction(Term):
    """The row-wise product of two fitted parents' bases.

    Splines, polynomials and numerics times a categorical give one part for each level but the base; categorical
    pairs give an indicator for each pair of levels but the bases; numeric and polynomial pairs all products.
    """

    left: Term
    right: Term

    @property
    def name(self) -> str:
        return f"{self.left.name}:{self.right.name}"

    @property
    def columns(self):
        return (*self.left.columns, *self.right.columns)

    @property
    def size(self) -> int:
        return self.left.size * self.right.size

    def learned(self, stats: Stats) -> Term:
        if any(getattr(t, "scop", False) for t in (self.left, self.right)):
            raise ValueError("a monotone smooth cannot be part of an interaction")
        return replace(self, left=self.left.learned(stats), right=self.right.learned(stats))

    def with_parents(self, left: Term, right: Term) -> Interaction:
        if any(getattr(t, "scop", False) for t in (left, right)):
            raise ValueError("a monotone smooth cannot be part of an interaction")
        return replace(self, left=left, right=right)

    def raw(self, data):
        return splines.row_kron(self.left.design(data), self.right.design(data))

    def penalties(self):
        n, m = self.left.size, self.right.size
        out = [Penalty(f"{self.name}:{p.name}", np.kron(p.matrix, np.eye(m)), p.policy) for p in self.left.penalties()]
        return out + [Penalty(f"{self.name}:{p.name}", np.kron(np.eye(n), p.matrix), p.policy) for p in self.right.penalties()]

    def effect(self, beta):
        b = np.asarray(beta, float).reshape(self.left.size, self.right.size)
        if isinstance(self.right, Categorical):
            c, out = self.right.value(), F.lit(0.0)
            for j, level in enumerate(self.right.others):
                out = F.when(c == level, self.left.effect(b[:, j])).otherwise(out)
            return unseen(c, self.right.levels, self.right.column, out)
        if isinstance(self.left, Categorical):
            return replace(self, left=self.right, right=self.left).effect(b.T.ravel())
        out = F.lit(0.0)
        for i in range(self.left.size):
            unit = np.zeros(self.left.size)
            unit[i] = 1.0
            out = out + self.left.effect(unit) * self.right.effect(b[i])
        return out

    def key(self):
        a, b = self.left.key(), self.right.key()
        return None if a is None or b is None else [*a, *b]


def TensorInteraction(left: Spline, right: Spline, n_knots: tuple[int, int] | int | None = None) -> Interaction:
    """A smooth surface: the product of two centred marginal smooths, penalised along each."""
    if left.select or right.select or len(left.m) > 1 or len(right.m) > 1:
        raise ValueError("tensor parents take neither select nor several orders")
    if n_knots is not None:
        a, b = (n_knots, n_knots) if isinstance(n_knots, int) else n_knots
        left, right = replace(left, n_knots=a), replace(right, n_knots=b)
    return Interaction(left, right)


def detect(df: DataFrame, splines_of: Sequence[str] = (), n_knots: int | Sequence[int] = 10, skip: Sequence[str] = ()) -> list[Term]:
    """Terms from column types: the listed columns as P-splines, strings and booleans as categoricals, else numerics."""
    counts = [n_knots] * len(splines_of) if isinstance(n_knots, int) else list(n_knots)
    if len(counts) != len(splines_of):
        raise ValueError("give one number of knots, or one for each spline column")
    by_name = dict(zip(splines_of, counts, strict=True))
    out: list[Term] = []
    for f in df.schema:
        if f.name in skip:
            continue
        if f.name in by_name:
            out.append(Spline(f.name, n_knots=by_name[f.name]))
        elif f.dataType.typeName() in ("string", "boolean"):
            out.append(Categorical(f.name))
        else:
            out.append(Numeric(f.name))
    return out


__all__ = ["BSplineSmooth", "CardinalCRSpline", "Categorical", "Constraint", "ConstraintSpec", "CubicRegressionSpline", "Interaction", "LambdaPolicy", "LevelGrouping", "NaturalSpline", "Numeric", "OrderedCategorical", "PSpline", "Polynomial", "Spline", "Stats", "TensorInteraction", "Term", "collapse_levels", "detect", "n_knots_from_k"]
