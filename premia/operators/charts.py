"""Validation tables of a scored DataFrame: equal-weight bins, lift, double lift, Lorenz curve, loss ratio.

Running totals over all rows are taken without a task that holds them: rows are dealt into ranges of the sort keys,
range totals are added up (one row for each range), and each range is summed by itself.

Ties: the sort keys are the score and then the `ties` columns; give columns that make the order total where results
must not depend on the order of equal scores.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from premia.sources.scratch import written


def running(df: DataFrame, keys: Sequence[Column], totals: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """df with running totals (inclusive) in the order of keys, and `<name>__all`, the grand total of each."""
    spark = df.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumns({f"__k{i}": k for i, k in enumerate(keys)} | {f"__t_{m}": c.cast("double") for m, c in totals.items()})
    names = [F.col(f"__k{i}") for i in range(len(keys))]
    # written once: the ranges come from a sample, and both branches below must see the same ones
    rows = written(rows.repartitionByRange(n, *names).withColumn("__range", F.spark_partition_id()))
    sums = rows.groupBy("__range").agg(*(F.sum(f"__t_{m}").alias(f"__s_{m}") for m in totals))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select("__range", *(F.coalesce(F.sum(f"__s_{m}").over(before), F.lit(0.0)).alias(f"__b_{m}") for m in totals), *(F.sum(f"__s_{m}").over(every).alias(f"{m}__all") for m in totals))
    inside = Window.partitionBy("__range").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"__r_{m}": F.sum(f"__t_{m}").over(inside) for m in totals}).join(F.broadcast(sums), "__range")  # n rows
    rows = rows.withColumns({m: F.col(f"__r_{m}") + F.col(f"__b_{m}") for m in totals})
    return rows.drop("__range", *(f"__k{i}" for i in range(len(keys))), *(f"__{a}_{m}" for a in "trb" for m in totals))


def equal_weight_bins(df: DataFrame, score: Column, weight: Column, n_bins: int, ties: Sequence[str] = (), name: str = "bin", place: str | None = None) -> DataFrame:
    """df with a bin from 1 to n_bins: the first whose share of the total weight reaches the row's running weight.

    place: also the row's number in this order, under this name.
    """
    rows = running(df, [score, *(F.col(f"`{c}`") for c in ties)], {"__cum": weight} | ({place: F.lit(1)} if place else {}))
    at = F.ceil(F.col("__cum") * n_bins / F.col("__cum__all"))
    return rows.withColumn(name, F.least(F.greatest(at, F.lit(1)), F.lit(n_bins)).cast("int")).drop("__cum", "__cum__all", f"{place}__all")


def bin_medians(rows: DataFrame, value: str, place: str, name: str) -> DataFrame:
    """bin, name: the median of a value that the rows are ordered by; the middle rows of each bin are picked by place."""
    ends = rows.groupBy("bin").agg(F.min(place).alias("__first"), F.count("*").alias("__n"))  # one row for each bin
    middle = rows.select("bin", value, place).join(ends, "bin").withColumn("__at", F.col(place) - F.col("__first"))
    some = middle.filter((F.col("__at") == F.floor((F.col("__n") - 1) / 2)) | (F.col("__at") == F.floor(F.col("__n") / 2)))
    return some.groupBy("bin").agg(F.avg(value).alias(name))


def _mass(weight: str | None, exposure: str | None) -> Column:
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    return w * F.col(f"`{exposure}`").cast("double") if exposure else w


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def lift(df: DataFrame, y: str, pred: str, weight: str | None = None, exposure: str | None = None, n_bins: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """bin, exposure_share, observed, predicted, obs_pred_ratio by equal-exposure bins of the prediction."""
    m = _mass(weight, exposure)
    rows = equal_weight_bins(df.withColumn("__m", m), F.col(f"`{pred}`"), F.col("__m"), n_bins, ties)
    g = rows.groupBy("bin").agg(F.sum("__m").alias("m"), F.sum(F.col("__m") * F.col(f"`{y}`")).alias("o"), F.sum(F.col("__m") * F.col(f"`{pred}`")).alias("p"))
    total = F.sum("m").over(Window.partitionBy())
    return g.select("bin", (F.col("m") / total).alias("exposure_share"), _ratio(F.col("o"), F.col("m")).alias("observed"), _ratio(F.col("p"), F.col("m")).alias("predicted"), _ratio(F.col("o"), F.col("p")).alias("obs_pred_ratio"))


def double_lift(df: DataFrame, y: str, model: str, current: str, weight: str | None = None, exposure: str | None = None, n_bins: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """Bins of the ratio model / current: averages, indices against the whole, and the range of the ratio."""
    score = F.col(f"`{model}`") / F.greatest(F.col(f"`{current}`"), F.lit(1e-10))
    rows = df.withColumns({"__m": _mass(weight, exposure), "__s": score}).filter("__m > 0")
    rows = written(equal_weight_bins(rows, F.col("__s"), F.col("__m"), n_bins, ties, place="__place"))
    s = lambda c: F.sum(F.col("__m") * F.col(f"`{c}`"))
    g = rows.groupBy("bin").agg(F.count("*").alias("n_rows"), F.sum("__m").alias("exposure_sum"), s(y).alias("target_sum"), s(model).alias("__a"), s(current).alias("__c"), F.min("__s").alias("sort_score_min"), F.max("__s").alias("sort_score_max"))
    g = g.join(bin_medians(rows, "__s", "__place", "sort_score_median"), "bin")
    whole = Window.partitionBy()
    e = F.col("exposure_sum")
    every = F.sum(e).over(whole)
    index = lambda c: (F.col(c) / e) / (F.sum(c).over(whole) / every)
    return g.select("bin", "n_rows", "exposure_sum", (e / every).alias("exposure_share"), "target_sum", (F.col("target_sum") / e).alias("actual_avg"), (F.col("__a") / e).alias("model_avg"), (F.col("__c") / e).alias("current_avg"), index("target_sum").alias("actual_index"), index("__a").alias("model_index"), index("__c").alias("current_index"), "sort_score_min", "sort_score_median", "sort_score_max")


def loss_ratio(df: DataFrame, y: str, pred: str, weight: str | None = None, exposure: str | None = None, n_bins: int = 10, feature: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """bin, exposure_share, observed, predicted by bins of the prediction or of a feature."""
    rows = df.withColumn("__m", _mass(weight, exposure))
    rows = equal_weight_bins(rows, F.col(f"`{feature or pred}`"), F.col("__m"), n_bins, ties)
    g = rows.groupBy("bin").agg(F.sum("__m").alias("m"), F.sum(F.col("__m") * F.col(f"`{y}`")).alias("o"), F.sum(F.col("__m") * F.col(f"`{pred}`")).alias("p"))
    return g.select("bin", (F.col("m") / F.sum("m").over(Window.partitionBy())).alias("exposure_share"), (F.col("o") / F.col("m")).alias("observed"), (F.col("p") / F.col("m")).alias("predicted"))


def _blocks(df: DataFrame, score: Column) -> DataFrame:
    """Running shares of exposure and loss over blocks of equal score, ascending."""
    g = df.select(score.alias("s"), "m", "l").groupBy("s").agg(F.sum("m").alias("m"), F.sum("l").alias("l"))
    out = running(g, [F.col("s")], {"cm": F.col("m"), "cl": F.col("l")})
    return out.withColumns({"x": F.col("cm") / F.col("cm__all"), "y": F.col("cl") / F.col("cl__all"), "dx": F.col("m") / F.col("cm__all"), "dy": F.col("l") / F.col("cl__all")}).select("s", "x", "y", "dx", "dy")


def lorenz(df: DataFrame, y: str, pred: str, weight: str | None = None, exposure: str | None = None) -> DataFrame:
    """cum_exposure_share, cum_loss_share_ordered (the diagonal), _model, _perfect at the model's points."""
    rows = df.select(_mass(weight, exposure).alias("m"), (_mass(weight, exposure) * F.col(f"`{y}`")).alias("l"), F.col(f"`{pred}`").alias("p"), F.col(f"`{y}`").alias("t")).filter("m > 0")
    model = _blocks(rows, F.col("p")).select("x", F.col("y").alias("model"))
    perfect = _blocks(rows, F.col("t")).select("x", "y")
    both = model.select("x", "model", F.lit(None).cast("double").alias("perfect")).unionByName(perfect.select("x", F.lit(None).cast("double").alias("model"), F.col("y").alias("perfect")))
    # the perfect curve at the model's points: between its neighbours, which a range-dealt order finds
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = written(both.repartitionByRange(n, "x").withColumn("r", F.spark_partition_id()))
    key = F.when(F.col("perfect").isNotNull(), F.struct("x", "perfect"))
    edges = both.groupBy("r").agg(F.max(key).alias("hi"), F.min(key).alias("lo"))
    up, down = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("r").rowsBetween(1, Window.unboundedFollowing)
    edges = edges.select("r", F.last("hi", ignorenulls=True).over(up).alias("before"), F.first("lo", ignorenulls=True).over(down).alias("after"))
    order = Window.partitionBy("r").orderBy("x", F.col("perfect").isNull())
    left = F.coalesce(F.last(key, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("before"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("perfect")))
    right = F.coalesce(F.first(key, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)), F.col("after"), F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("perfect")))
    out = both.join(F.broadcast(edges), "r").withColumns({"a": left, "b": right}).filter(F.col("model").isNotNull())
    share = F.when(F.col("b.x") > F.col("a.x"), (F.col("x") - F.col("a.x")) / (F.col("b.x") - F.col("a.x"))).otherwise(0.0)
    out = out.select(F.col("x").alias("cum_exposure_share"), F.col("x").alias("cum_loss_share_ordered"), F.col("model").alias("cum_loss_share_model"), (F.col("a.perfect") + share * (F.col("b.perfect") - F.col("a.perfect"))).alias("cum_loss_share_perfect"))
    zero = out.sparkSession.createDataFrame([(0.0, 0.0, 0.0, 0.0)], out.schema)
    return zero.unionByName(out)


def gini(df: DataFrame, y: str, pred: str, weight: str | None = None, exposure: str | None = None) -> DataFrame:
    """gini_model, gini_perfect, gini_ratio: trapezoids under the Lorenz curves, ties as one block."""
    rows = df.select(_mass(weight, exposure).alias("m"), (_mass(weight, exposure) * F.col(f"`{y}`")).alias("l"), F.col(f"`{pred}`").alias("p"), F.col(f"`{y}`").alias("t")).filter("m > 0")
    area = lambda score: _blocks(rows, F.col(score)).agg((1 - F.sum(F.col("dx") * (2 * F.col("y") - F.col("dy")))).alias(score))
    both = area("p").crossJoin(area("t"))  # one row each
    return both.select(F.col("p").alias("gini_model"), F.col("t").alias("gini_perfect"), _ratio(F.col("p"), F.col("t")).alias("gini_ratio"))


def gini_cv(df: DataFrame, y: str, pred: str, weight: str | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """gini_cv: 1 - 2 sum(w * cumulative loss) / (W L) in prediction order, ties not collapsed."""
    w = _mass(weight, None)
    rows = running(df.withColumn("__w", w), [F.col(f"`{pred}`"), *(F.col(f"`{c}`") for c in ties)], {"__cl": w * F.col(f"`{y}`"), "__cw": w})
    return rows.agg((1 - 2 * F.sum(F.col("__w") * F.col("__cl")) / (F.max("__cw__all") * F.max("__cl__all"))).alias("gini_cv"))


def calibration(df: DataFrame, y: str, pred: str, weight: str | None = None, n_bins: int = 20, ties: Sequence[str] = ()) -> DataFrame:
    """Equal-exposure points of observed against predicted."""
    return lift(df, y, pred, weight, None, n_bins, ties).select("bin", "observed", "predicted")


# -- edges for rating tables -----------------------------------------------------------------------------------------
def weighted_quantile_edges(df: DataFrame, x: str, weight: str | None, n_bins: int, ties: Sequence[str] = ()) -> list[float]:
    """Distinct edges that cut the total weight into equal parts (n_bins + 1 numbers at most)."""
    rows = equal_weight_bins(df.select(F.col(f"`{x}`").cast("double").alias("x"), _mass(weight, None).alias("m"), *(F.col(f"`{c}`") for c in ties)), F.col("x"), F.col("m"), n_bins, ties)
    got = rows.groupBy("bin").agg(F.max("x").alias("hi"), F.min("x").alias("lo")).orderBy("bin").collect()
    return sorted({got[0]["lo"], *(r["hi"] for r in got)})


def uniform_edges(df: DataFrame, x: str, n_bins: int) -> list[float]:
    lo, hi = df.agg(F.min(F.col(f"`{x}`").cast("double")), F.max(F.col(f"`{x}`").cast("double"))).first()
    return [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]


def winsorised_edges(df: DataFrame, x: str, weight: str | None, n_bins: int, ties: Sequence[str] = ()) -> list[float]:
    """Tail bins beyond the 5th and 95th weighted percentile, weighted quantiles between."""
    if n_bins < 3:
        return weighted_quantile_edges(df, x, weight, n_bins, ties)
    e = weighted_quantile_edges(df, x, weight, 20, ties)
    lo, hi, p5, p95 = e[0], e[-1], e[min(1, len(e) - 1)], e[max(0, len(e) - 2)]
    if p5 >= p95:
        return weighted_quantile_edges(df, x, weight, n_bins, ties)
    inner = weighted_quantile_edges(df.filter(F.col(f"`{x}`").between(p5, p95)), x, weight, n_bins - 2, ties)
    return sorted({lo, p5, *inner, p95, hi})


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Which of the closed-right bins between edges x falls into, from 0; ends are open."""
    at = F.lit(0)
    for e in edges[1:-1]:
        at = at + F.when(x > e, 1).otherwise(0)
    return at


def discretised(df: DataFrame, x: str, n_bins: int = 256) -> DataFrame:
    """df with `<x>_bin` (centre): the value itself if there are at most n_bins distinct ones, else equal bins."""
    c = F.col(f"`{x}`").cast("double")
    if df.select(c.alias("x")).distinct().limit(n_bins + 1).count() <= n_bins:
        return df.withColumn(f"{x}_bin", c)
    lo, hi = df.agg(F.min(c), F.max(c)).first()
    width = (hi - lo) / n_bins
    return df.withColumn(f"{x}_bin", lo + (F.least(F.greatest(F.floor((c - lo) / width), F.lit(0)), F.lit(n_bins - 1)) + 0.5) * width)
