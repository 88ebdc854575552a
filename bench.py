"""Headline queries, timed. One JSON line: {"metric", "value", "unit", "queries", "sf"}.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say where and on how many threads.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + ":" + os.environ.get("PYTHONPATH", "")

from premia import queries  # noqa: E402
from premia.model import Glm  # noqa: E402
from premia.operators.terms import Categorical, Spline  # noqa: E402


def reml_fit(spark: SparkSession, sf_dir: str):
    """Three smooths on discrete columns and a factor, smoothing parameters by REML, over all of lineitem."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    terms = [Spline(c, kind="cr", n_knots=n, discrete=True) for c, n in (("l_quantity", 10), ("l_discount", 6), ("l_tax", 5))]
    model = Glm("poisson", [*terms, Categorical("l_returnflag")]).fit_reml(df.withColumn("y", F.floor(F.col("l_extendedprice") / 10000)), "y")
    return model.coefficients(spark)


def reml_continuous(spark: SparkSession, sf_dir: str):
    """Three smooths of continuous columns in 256 bins and a factor over all rows of lineitem, rows left in Spark."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_extendedprice", "l_returnflag", (F.col("l_partkey") * 1.0).alias("part"), (F.col("l_orderkey") * 1.0).alias("order"), F.floor(F.col("l_quantity") / 10 + F.col("l_extendedprice") / 40000).alias("y")
    )
    terms = [Spline(c, kind="cr", n_knots=10, discrete=True) for c in ("l_extendedprice", "part", "order")]
    return Glm("poisson", [*terms, Categorical("l_returnflag")]).fit_reml(df, "y").coefficients(spark)


def score_rows(spark: SparkSession, sf_dir: str):
    """Fit on cells, then score every row of lineitem with the generated column."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    model = Glm("gamma", [Spline("l_quantity", discrete=True), Categorical("l_returnflag")], link="log").fit(df, "l_extendedprice")
    return model.predict(df, name="mu").agg(F.sum("mu").alias("total"))


def kernel_fit(spark: SparkSession, sf_dir: str):
    """A smooth of a continuous column: one Arrow pass an iteration."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return Glm("gaussian", [Spline("l_extendedprice", n_knots=10), Categorical("l_returnflag")]).fit(df, "l_quantity").coefficients(spark)


HEADLINE = {"reml_fit": reml_fit, "reml_continuous": reml_continuous, "score_rows": score_rows, "kernel_fit": kernel_fit} | {n: queries.QUERIES[n] for n in ("poisson_one_factor", "gamma_saturated", "lift_chart", "double_lift_chart", "lorenz_curve", "gini", "cross_validation", "residual_kinds", "fit_statistics", "lasso_path")}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    HEADLINE["poisson_one_factor"](spark, sf_dir).collect()  # start the JVM's and Python's workers
    took = {}
    for name, run in HEADLINE.items():
        best = None
        for _ in range(2):
            began = time.time()
            run(spark, sf_dir).collect()
            best = min(best or 1e9, time.time() - began)
        took[name] = round(best, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1]) if found else None}))


if __name__ == "__main__":
    main()
