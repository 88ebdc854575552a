"""The model frame and the sums a fit needs from its rows.

Rows stay in Spark. Where every term has few distinct values, one groupBy compresses the rows to cells (distinct term
values and offset, with the totals that the likelihood needs), and the iterations run on the collected cells, at most
MAX_CELLS of them. Otherwise each iteration is one job: an Arrow kernel sums [1, X]'W[1, X] and the rest over each
partition, and the driver adds one small row for each partition, in partition order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.functions.families import Family
from premia.functions.links import Link
from premia.operators.terms import Interaction, Numeric, Polynomial, Spline, Stats, Term

MAX_CELLS = 200_000
GROUPS = 64  # partitions whose sums are added up in one task before they come to the driver
ROLES = ("__y", "__w", "__o")


@contextmanager
def rows_only() -> Iterator[None]:
    """Fits in this block leave all rows in Spark, whatever the size of the table."""
    global MAX_CELLS
    before, MAX_CELLS = MAX_CELLS, 0
    try:
        yield
    finally:
        MAX_CELLS = before


@dataclass(frozen=True)
class Frame:
    """Rows with a response, a weight (1 if none) and an offset (0 if none; several columns are added)."""

    df: DataFrame
    has_offset: bool = False

    @staticmethod
    def of(df: DataFrame, y: str, weight: str | None = None, offset: str | Sequence[str] | None = None, columns: Sequence[str] = ()) -> Frame:
        offsets = [offset] if isinstance(offset, str) else list(offset or [])
        o = F.lit(0.0)
        for c in offsets:
            o = o + F.col(f"`{c}`").cast("double")
        keep = [F.col(f"`{c}`") for c in dict.fromkeys(columns)]
        w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
        return Frame(df.select(*keep, F.col(f"`{y}`").cast("double").alias("__y"), w.alias("__w"), o.alias("__o")), bool(offsets))

    def check(self, family: Family) -> dict:
        """Rows, total weight and weighted mean; invalid responses or weights are an error."""
        bad = F.sum(F.when(family.invalid(F.col("__y")), 1).otherwise(0))
        odd = F.sum(F.when(F.col("__w").isNull() | (F.col("__w") < 0) | F.col("__o").isNull(), 1).otherwise(0))
        row = self.df.agg(F.count("*").alias("n"), F.sum("__w").alias("w"), F.sum(F.col("__w") * F.col("__y")).alias("wy"), bad.alias("bad"), odd.alias("odd")).first()
        if not row["n"]:
            raise ValueError("no rows")
        if row["bad"] or row["odd"]:
            raise ValueError(f"{row['bad']} invalid responses for {family.name}, {row['odd']} invalid weights or offsets")
        if not row["w"] > 0:
            raise ValueError("the weights add up to zero")
        return {"n": row["n"], "w": row["w"], "mean": row["wy"] / row["w"]}


class Design:
    """Fitted terms and the columns they fill, after the intercept."""

    def __init__(self, terms: Sequence[Term]):
        self.terms = tuple(terms)
        edges = np.cumsum([0, *(t.size for t in self.terms)])
        self.slices = {t.name: slice(int(a), int(b)) for t, a, b in zip(self.terms, edges, edges[1:], strict=False)}
        self.size = int(edges[-1])

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.terms for c in t.columns))

    def matrix(self, data) -> np.ndarray:
        n = len(data["__y"])
        return np.hstack([np.ones((n, 1)), *(t.design(data) for t in self.terms)])

    def penalties(self) -> list[tuple[str, np.ndarray, object]]:
        """(name, matrix in all coefficients, policy)."""
        out = []
        for t in self.terms:
            for p in t.penalties():
                s = np.zeros((self.size, self.size))
                s[self.slices[t.name], self.slices[t.name]] = p.matrix
                out.append((p.name, s, p.policy))
        return out

    def effect(self, beta: np.ndarray):
        out = F.lit(0.0)
        for t in self.terms:
            out = out + t.effect(beta[self.slices[t.name]])
        return out


def irls_weights(family: Family, link: Link, eta: np.ndarray, w: np.ndarray):
    """(mu, working weight, d eta / d mu) at a linear predictor."""
    eta = link.stabilise(eta)
    mu = family.clip(link.inverse(eta))
    d = link.deriv_inverse(eta)
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    return mu, w * d * d / np.maximum(family.variance(mu), 1e-300), 1 / d


def weight_derivatives(family: Family, link: Link, eta: np.ndarray, w: np.ndarray):
    """First and second derivative of the working weight by the linear predictor."""
    eta = link.stabilise(eta)
    mu = family.clip(link.inverse(eta))
    d1, d2, d3 = link.deriv_inverse(eta), link.deriv2_inverse(eta), link.deriv3_inverse(eta)
    v, v1, v2 = np.maximum(family.variance(mu), 1e-300), family.variance_derivative(mu), family.variance_second_derivative(mu)
    first = w * (2 * d1 * d2 / v - d1**3 * v1 / v**2)
    second = w * (2 * (d2 * d2 + d1 * d3) / v - 5 * d1 * d1 * d2 * v1 / v**2 - d1**4 * v2 / v**2 + 2 * d1**4 * v1 * v1 / v**3)
    return first, second


def curvature_of(x: np.ndarray, part: dict, b: np.ndarray, family: Family, link: Link, hinv: np.ndarray, moves: np.ndarray) -> dict[str, np.ndarray]:
    """What the derivatives of log|X'WX + S| need, summed over some rows or cells; all smoothing parameters at once.

    g: X'(W' h) and q: X'diag(W'' h)X, with h the row's x'(hinv)x; c: X'diag(W' X m)X for each row m of moves (signed
    Grams); o: X'WX with the observed in place of the expected weights.
    """
    eta = x @ b + part["o"]
    first, second = weight_derivatives(family, link, eta, part["w"])
    eta = link.stabilise(eta)
    mu = family.clip(link.inverse(eta))
    d1, d2, v, v1 = link.deriv_inverse(eta), link.deriv2_inverse(eta), np.maximum(family.variance(mu), 1e-300), family.variance_derivative(mu)
    observed = part["w"] * (d1 * d1 / v - (part["y"] - mu) * (d2 / v - d1 * d1 * v1 / v**2))
    hat = np.einsum("ij,jk,ik->i", x, hinv, x)
    shifts = x @ moves.T
    return {
        "g": x.T @ (first * hat), "q": (x * (second * hat)[:, None]).T @ x, "o": (x * observed[:, None]).T @ x,
        "c": np.stack([(x * (first * shifts[:, j])[:, None]).T @ x for j in range(len(moves))]) if len(moves) else np.zeros((0, x.shape[1], x.shape[1])),
    }


def sums_of(x: np.ndarray, part: dict, b: np.ndarray, family: Family, link: Link, meat: bool = False) -> dict[str, np.ndarray]:
    """Sums over some rows or cells. part: w, y (mean), o, n, a (sum of w a(y)), yy (sum of w y^2).

    meat (the middle of the sandwich covariance) is a second Gram, taken on request.
    """
    eta = x @ b + part["o"]
    mu, big, d = irls_weights(family, link, eta, part["w"])
    z = link.stabilise(eta) - part["o"] + (part["y"] - mu) * d
    v = np.maximum(family.variance(mu), 1e-300)
    xw = x * big[:, None]
    out = {
        "h": xw.T @ x, "g": xw.T @ z, "dev": np.array((part["a"] + part["w"] * (part["y"] * family.b(mu) + family.c(mu))).sum()),
        "pearson": np.array(((part["yy"] - 2 * part["w"] * part["y"] * mu + part["w"] * mu * mu) / v).sum()),
        "score": x.T @ (big * (part["y"] - mu) * d), "top": np.array(big.max(initial=0.0)), "wmu": np.array((part["w"] * mu).sum()), "zz": np.array((big * z * z).sum()),
    }
    if meat:
        rows = x * (big * d * (part["y"] - mu))[:, None]
        out["meat"] = rows.T @ rows
    return out


class Source:
    """Gives sums at a coefficient vector (intercept first)."""

    design: Design
    cells: int | None = None

    def over(self, kernel) -> dict[str, np.ndarray]:
        """Add what kernel(x, part) gives over all rows."""
        raise NotImplementedError

    def sums(self, b: np.ndarray, family: Family, link: Link, meat: bool = False) -> dict[str, np.ndarray]:
        return self.over(lambda x, part: sums_of(x, part, b, family, link, meat))

    def curvature(self, b: np.ndarray, family: Family, link: Link, hinv: np.ndarray, moves: np.ndarray) -> dict[str, np.ndarray]:
        return self.over(lambda x, part: curvature_of(x, part, b, family, link, hinv, moves))


class Cells(Source):
    """Collected cells; no Spark job for an iteration."""

    def __init__(self, design: Design, data: dict[str, np.ndarray]):
        self.design = design
        self.x = design.matrix(data | {"__y": data["__n"]})
        some = data["__w"] > 0
        self.part = {"w": data["__w"][some], "y": data["__wy"][some] / data["__w"][some], "o": data["__o"][some], "n": data["__n"][some], "a": data["__wa"][some], "yy": data["__wyy"][some]}
        self.all_x, self.x, self.rows, self.cells = self.x, self.x[some], data["__n"], len(data["__n"])

    def over(self, kernel):
        return kernel(self.x, self.part)


class Partitions(Source):
    """One job for each call; the partitions' sums are added up in groups, and the groups' on the driver."""

    def __init__(self, design: Design, df: DataFrame, family: Family):
        self.design, self.df, self.family = design, df, family
        self.groups = -(-df.rdd.getNumPartitions() // GROUPS)

    def reduce(self, kernel) -> dict[str, np.ndarray]:
        """Add what kernel(data) gives for each batch: a dict of arrays of fixed shape."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                if batch.num_rows:
                    data = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
                    for k, v in kernel(data).items():
                        v = np.asarray(v, float)
                        total[k] = v if k not in total else np.maximum(total[k], v) if k == "top" else total[k] + v
            if total:
                yield _packed(TaskContext.get().partitionId(), total)

        schema = "part int, names array<string>, shapes array<array<int>>, blobs array<binary>"
        rows = self.df.mapInArrow(run, schema)
        if self.groups > 1:
            near = F.floor(F.col("part") / GROUPS).cast("int")
            rows = rows.repartition(self.groups, near).mapInArrow(_added_up, schema)
        return _added([(r["part"], r["names"], r["shapes"], r["blobs"]) for r in rows.collect()])

    def over(self, kernel):
        design, family = self.design, self.family

        def of_rows(data):
            y, w = data["__y"].astype(float), data["__w"].astype(float)
            return kernel(design.matrix(data), {"w": w, "y": y, "o": data["__o"].astype(float), "a": w * family.a(y), "yy": w * y * y})

        return self.reduce(of_rows)


def _packed(part: int, total: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = list(total)
    shapes, blobs = [list(map(int, total[k].shape)) for k in names], [total[k].tobytes() for k in names]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([names]), pa.array([shapes], pa.list_(pa.list_(pa.int32()))), pa.array([blobs], pa.list_(pa.binary()))], names=["part", "names", "shapes", "blobs"])


def _added(rows: list[tuple]) -> dict[str, np.ndarray]:
    """Packed sums added in the order of their partitions, so that reruns agree to the last digit."""
    out: dict[str, np.ndarray] = {}
    for _, names, shapes, blobs in sorted(rows, key=lambda r: r[0]):
        for k, shape, blob in zip(names, shapes, blobs, strict=True):
            v = np.frombuffer(bytes(blob), float).reshape(shape)
            out[k] = v if k not in out else np.maximum(out[k], v) if k == "top" else out[k] + v
    return out


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            groups.setdefault(row[0] // GROUPS, []).append(row)
    for part, rows in groups.items():
        yield _packed(part, _added(rows))


def build(frame: Frame, terms: Sequence[Term], family: Family, n: int, lam: float = 0.1, max_cells: int | None = None) -> tuple[Source, list[Term]]:
    """Learn the terms and make the source of sums: cells if the terms or the number of rows allow it, else partitions.

    At most max_cells (MAX_CELLS if not given) cells or rows are collected; with more, the rows stay in Spark and are
    kept for the iterations. Both ways give the same sums up to rounding; 0 has the rows stay in Spark always.
    """
    max_cells = MAX_CELLS if max_cells is None else max_cells
    stats = Stats(frame.df, "__w")
    parts = [p for t in terms for p in ((t.left, t.right) if isinstance(t, Interaction) else (t,))]
    stats.ranges([c for p in parts if isinstance(p, Numeric | Polynomial | Spline) for c in p.columns])
    learned: list[Term] = []
    for t in terms:
        if isinstance(t, Interaction):
            known = {x.name: x for x in learned}
            t = t.with_parents(*(known[p.name] if p.name in known and type(known[p.name]) is type(p) else p.learned(stats) for p in (t.left, t.right)))
        else:
            t = t.learned(stats)
        learned.append(t)
    keys: dict[str, object] = {}
    groupable = True
    for t in learned:
        k = t.key()
        if k is None and n <= max_cells:
            k = [F.col(f"`{c}`") for c in t.columns]
        if k is None:
            groupable = False
            break
        keys |= dict(zip(t.columns, k, strict=True))
    data = None
    if groupable and max_cells:
        y, w = F.col("__y"), F.col("__w")
        cells = frame.df.groupBy(*keys.values(), F.col("__o")).agg(F.count("*").cast("double").alias("__n"), F.sum("__w").alias("__w"), F.sum(w * y).alias("__wy"), F.sum(w * y * y).alias("__wyy"), F.sum(w * family.a(y)).alias("__wa"))
        rows = cells.limit(max_cells + 1).toPandas()
        if len(rows) <= max_cells:
            rows = rows.sort_values([*keys, "__o"], kind="stable")
            data = {c: rows[c].to_numpy() for c in rows.columns}
    if data is not None:
        count, mass = data["__n"], data["__w"]
        learned = _finish(learned, lambda raw_terms: _raw_sums(raw_terms, data, count, mass), mass.sum(), lam)
        return Cells(Design(learned), data), learned
    source = Partitions(Design([]), frame.df, family)

    def over_rows(raw_terms):
        return source.reduce(lambda d: _raw_sums(raw_terms, d, np.ones(len(d["__y"])), d["__w"].astype(float)))

    total = source.reduce(lambda d: {"w": d["__w"].astype(float).sum()})["w"]
    learned = _finish(learned, over_rows, float(total), lam)
    source.design = Design(learned)
    return source, learned


def _raw_sums(terms: Sequence[Term], data, count: np.ndarray, mass: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for i, t in enumerate(terms):
        raw = t.raw(data)
        out[f"s{i}"], out[f"g{i}"] = count @ raw, (raw * mass[:, None]).T @ raw
    return out


def _finish(terms: Sequence[Term], sums, total: float, lam: float) -> list[Term]:
    """Centre and scale the terms that need it; interactions take their parents' finished bases."""
    parents = {}
    for t in terms:
        for p in (t.left, t.right) if isinstance(t, Interaction) else (t,):
            parents.setdefault((p.name, repr(p)), p)
    need = list(parents.values())
    got = sums(need)
    done = {k: p.finished(got[f"s{i}"], got[f"g{i}"], total, lam) for i, (k, p) in enumerate(parents.items())}
    out = []
    for t in terms:
        if isinstance(t, Interaction):
            out.append(t.with_parents(done[t.left.name, repr(t.left)], done[t.right.name, repr(t.right)]))
        else:
            out.append(done[t.name, repr(t)])
    return out
