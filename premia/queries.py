"""Registered queries for the modelling operators, with the same result in DuckDB's SQL where SQL can give it.

Fitted models are checked by identities: with one factor and a canonical or log link the fitted mean of a level is its
weighted mean; a saturated model gives cell means; an unpenalised Gaussian line is the regression line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from premia.functions import families, links
from premia.model import Glm
from premia.operators import adequacy, charts, frame
from premia.operators.terms import Categorical, Constraint, Interaction, LambdaPolicy, Numeric, OrderedCategorical, Polynomial, Spline, TensorInteraction, collapse_levels, detect
from premia.plans import select, solve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")

# SQL views that several oracles start from.
COUNTS = "counts AS (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice, count(*)::DOUBLE AS y FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
SCORED = COUNTS + ", means AS (SELECT o_orderpriority, avg(y) AS mu FROM counts GROUP BY 1), scored AS (SELECT c.*, m.mu, 1 + (o_orderkey % 5)::DOUBLE AS w FROM counts c JOIN means m USING (o_orderpriority))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order, a count response; w is an integer weight."""
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("y"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return lines.join(orders, "o_orderkey").withColumn("w", 1 + (F.col("o_orderkey") % 5).cast("double"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """counts with mu, the mean of a fitted one-factor Poisson model."""
    df = counts(spark, sf_dir)
    return Glm("poisson", [Categorical("o_orderpriority")]).fit(df, "y").predict(df, name="mu").withColumn("mu", F.round("mu", 9))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, integers as long."""
    kinds = {"double": lambda c: r6(c), "int": lambda c: F.col(c).cast("long"), "bigint": lambda c: F.col(c)}
    return df.select(*(kinds.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


def level_means(df: DataFrame, spec: Glm, keys: list[str], y: str, weight=None, offset=None) -> DataFrame:
    """Fit, score, and one row for each combination of keys."""
    model = spec.fit(df, y, weight, offset)
    return model.predict(df, offset, "mu").groupBy(*keys).agg(r6(F.avg("mu")).alias("mu"))


# -- families and links ----------------------------------------------------------------------------------------------
def _deviance_sql(name: str, unit: str) -> str:
    return f"SELECT l_returnflag, round(sum(l_quantity * ({unit})), 2) AS deviance FROM (SELECT *, l_extendedprice / 1000 AS y, (SELECT avg(l_extendedprice / 1000) FROM lineitem) AS m FROM lineitem) GROUP BY 1"


def _deviance(family) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000)
        m = F.lit(df.agg(F.avg("y")).first()[0])
        return df.groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * family.deviance(F.col("y"), m)), 2).alias("deviance"))

    return run


for _name, _family, _unit in (
    ("poisson", families.poisson(), "2 * (y * ln(y / m) - (y - m))"),
    ("gaussian", families.gaussian(), "(y - m) * (y - m)"),
    ("gamma", families.gamma(), "2 * ((y - m) / m - ln(y / m))"),
    ("nb2", families.nb2(2.0), "2 * (y * ln(y / m) - (y + 2) * ln((y + 2) / (m + 2)))"),
    ("tweedie", families.tweedie(1.5), "2 * (y ** 0.5 / (-0.25) - y * m ** (-0.5) / (-0.5) + m ** 0.5 / 0.5)"),
):
    QUERIES[f"deviance_{_name}"] = _deviance(_family)
    ORACLE_SQL[f"deviance_{_name}"] = _deviance_sql(_name, _unit)


@query("SELECT quality, round(sum(-2 * (quality * ln(m) + (1 - quality) * ln(1 - m))), 4) AS deviance, round(sum(m * (1 - m)), 4) AS variance FROM (SELECT quality, 0.25 + 0.5 * ((doc_id % 7) / 7.0)::DOUBLE AS m FROM labels) GROUP BY 1")
def deviance_binomial(spark, sf_dir):
    f = families.binomial()
    df = read(spark, sf_dir, "labels").withColumn("m", 0.25 + 0.5 * ((F.col("doc_id") % 7) / 7.0))
    y = F.col("quality").cast("double")
    return df.groupBy("quality").agg(F.round(F.sum(f.deviance(y, F.col("m"))), 4).alias("deviance"), F.round(F.sum(f.variance(F.col("m"))), 4).alias("variance"))


_LINK_SQL = {
    "log": ("ln(m)", "exp(e)"), "identity": ("m", "e"), "logit": ("ln(m / (1 - m))", "1 / (1 + exp(-e))"), "cloglog": ("ln(-ln(1 - m))", "1 - exp(-exp(e))"), "cauchit": ("tan(pi() * (m - 0.5))", "0.5 + atan(e) / pi()"),
    "inverse": ("1 / m", "1 / e"), "inverse_squared": ("1 / (m * m)", "1 / sqrt(e)"), "sqrt": ("sqrt(m)", "e * e"), "nb": ("ln(m / (m + 1))", "exp(e) / (1 - exp(e))"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS link, l_discount, round({a}, 6) AS eta, round({b}, 6) AS mu FROM (SELECT *, {a} AS e FROM (SELECT DISTINCT l_discount, 0.05 + 8 * l_discount AS m FROM lineitem WHERE l_discount < 0.1))" for k, (a, b) in _LINK_SQL.items()))
def link_functions(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").filter("l_discount < 0.1").select("l_discount").distinct().withColumn("m", 0.05 + 8 * F.col("l_discount"))
    out = None
    for name in _LINK_SQL:
        link = links.NAMED[name]()
        part = df.withColumn("e", link.link(F.col("m"))).select(F.lit(name).alias("link"), "l_discount", r6(F.col("e")).alias("eta"), r6(link.inverse(F.col("e"))).alias("mu"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {SCORED} SELECT count(*) AS n_obs, round(sum(2 * (y * ln(y / mu) - (y - mu))), 4) AS deviance, round(sum((y - mu) ** 2 / mu), 4) AS pearson_chi2, round(sum(y * ln(mu) - mu - lgamma(y + 1)), 4) AS log_likelihood FROM scored")
def fit_statistics(spark, sf_dir):
    out = adequacy.fit_stats(scored(spark, sf_dir), "y", "mu", families.poisson())
    return out.select("n_obs", *(F.round(c, 4).alias(c) for c in ("deviance", "pearson_chi2", "log_likelihood")))


@query(f"WITH {SCORED}, s AS (SELECT sum(y * ln(mu) - mu - lgamma(y + 1)) AS ll, count(*) AS n FROM scored) SELECT round(-2 * ll + 10, 4) AS aic, round(-2 * ll + 5 * ln(n), 4) AS bic, round(-2 * ll + 10 + 60.0 / (n - 6), 4) AS aicc FROM s")
def information_criteria(spark, sf_dir):
    df = counts(spark, sf_dir)
    return Glm("poisson", [Categorical("o_orderpriority")]).fit(df, "y").metrics(df, "y").select(*(F.round(c, 4).alias(c) for c in ("aic", "bic", "aicc")))


@query(f"WITH {SCORED} SELECT o_orderkey, round(y - mu, 6) AS response, round((y - mu) / sqrt(mu), 6) AS pearson, round((y - mu) / mu, 6) AS working, round(sign(y - mu) * sqrt(greatest(2 * (y * ln(y / mu) - (y - mu)), 0)), 5) AS deviance FROM scored")
def residual_kinds(spark, sf_dir):
    df, f, g = scored(spark, sf_dir), families.poisson(), links.Log()
    for kind in ("response", "pearson", "working", "deviance"):
        df = adequacy.residuals(df, "y", "mu", f, g, kind, name=kind)
    return df.select("o_orderkey", *(r6(c).alias(c) for c in ("response", "pearson", "working")), F.round("deviance", 5).alias("deviance"))


# -- fits checked by identities --------------------------------------------------------------------------------------
@query(f"WITH {COUNTS} SELECT o_orderpriority, round(avg(y), 6) AS mu FROM counts GROUP BY 1")
def poisson_one_factor(spark, sf_dir):
    return level_means(counts(spark, sf_dir), Glm("poisson", [Categorical("o_orderpriority")]), ["o_orderpriority"], "y")


@query(f"WITH {COUNTS} SELECT o_orderpriority, round(sum((1 + o_orderkey % 5) * y) / sum(1 + o_orderkey % 5), 6) AS mu FROM counts GROUP BY 1")
def poisson_weighted(spark, sf_dir):
    return level_means(counts(spark, sf_dir), Glm("poisson", [Categorical("o_orderpriority", base="first")]), ["o_orderpriority"], "y", "w")


@query("SELECT l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 4) AS rate FROM lineitem GROUP BY 1")
def poisson_offset(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("log_quantity", F.log("l_quantity"))
    model = Glm("poisson", [Categorical("l_returnflag")]).fit(df, "l_extendedprice", offset="log_quantity")
    return df.select("l_returnflag").distinct().withColumn("rate", F.round(model.mean(), 4))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 3) AS mu FROM lineitem GROUP BY 1, 2")
def gamma_saturated(spark, sf_dir):
    a, b = Categorical("l_returnflag"), Categorical("l_linestatus")
    df = read(spark, sf_dir, "lineitem")
    model = Glm("gamma", [a, b, Interaction(a, b)], link="log").fit(df, "l_extendedprice", "l_quantity")
    return df.select("l_returnflag", "l_linestatus").distinct().withColumn("mu", F.round(model.mean(), 3))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def gaussian_line(spark, sf_dir):
    model = Glm("gaussian", [Numeric("l_quantity")]).fit(read(spark, sf_dir, "lineitem"), "l_extendedprice")
    return spark.createDataFrame([(round(model.fit.intercept, 4), round(float(model.fit.beta[0]), 4))], "intercept double, slope double")


@query("SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY 1")
def gaussian_slopes_by_level(spark, sf_dir):
    x, c = Numeric("l_quantity"), Categorical("l_returnflag")
    df = read(spark, sf_dir, "lineitem")
    model = Glm("gaussian", [x, c, Interaction(x, c)]).fit(df, "l_extendedprice")
    at = df.select("l_returnflag").distinct()
    zero = model.predict(at.withColumn("l_quantity", F.lit(0.0)), name="intercept")
    return model.predict(zero.withColumn("l_quantity", F.lit(1.0)), name="one").select("l_returnflag", F.round("intercept", 4).alias("intercept"), F.round(F.col("one") - F.col("intercept"), 4).alias("slope"))


@query("SELECT lang, round(avg(quality), 6) AS rate FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def binomial_one_factor(spark, sf_dir):
    df = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return level_means(df, Glm("binomial", [Categorical("lang")]), ["lang"], "quality").withColumnRenamed("mu", "rate")


@query(f"WITH {COUNTS} SELECT o_orderstatus, round(avg(y), 6) AS mu FROM counts GROUP BY 1")
def nb2_one_factor(spark, sf_dir):
    return level_means(counts(spark, sf_dir), Glm(families.nb2(2.0), [Categorical("o_orderstatus")]), ["o_orderstatus"], "y")


@query("SELECT event_type != 'view' AS not_view, round(avg(CASE WHEN event_id % 3 = 0 THEN value ELSE 0 END), 5) AS mu FROM events GROUP BY 1")
def tweedie_one_factor(spark, sf_dir):
    df = read(spark, sf_dir, "events").select((F.col("event_type") != "view").alias("not_view"), F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(0.0).alias("y"))
    model = Glm(families.tweedie(1.5), [Categorical("not_view")]).fit(df, "y")
    return df.select("not_view").distinct().withColumn("mu", F.round(model.mean(), 5))


@query(f"WITH {COUNTS} SELECT CASE WHEN o_orderpriority >= '3' THEN '3-MEDIUM+' ELSE o_orderpriority END AS band, round(avg(y), 6) AS mu FROM counts GROUP BY 1")
def collapsed_levels(spark, sf_dir):
    grouping = collapse_levels(PRIORITIES, from_level="3-MEDIUM")
    df = counts(spark, sf_dir)
    model = Glm("poisson", [Categorical("o_orderpriority", grouping=grouping)]).fit(df, "y")
    return model.predict(df, name="mu").groupBy(grouping.column(F.col("o_orderpriority")).alias("band")).agg(r6(F.avg("mu")).alias("mu"))


@query(f"WITH {COUNTS} SELECT o_orderpriority, round(avg(y), 6) AS mu FROM counts GROUP BY 1")
def ordered_steps(spark, sf_dir):
    return level_means(counts(spark, sf_dir), Glm("poisson", [OrderedCategorical("o_orderpriority", order=PRIORITIES, basis="step")], spline_penalty=0.0), ["o_orderpriority"], "y")


@query("SELECT l_discount, round(avg(l_extendedprice), 3) AS mu FROM lineitem GROUP BY 1")
def spline_interpolates(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    model = Glm("gaussian", [Spline("l_discount", kind="cr_cardinal", n_knots=9, discrete=True)], spline_penalty=0.0).fit(df, "l_extendedprice")
    return df.select("l_discount").distinct().withColumn("mu", F.round(model.mean(), 3))


@query("SELECT l_tax, round(regr_intercept(l_extendedprice, l_tax) OVER () + regr_slope(l_extendedprice, l_tax) OVER () * l_tax, 0) AS mu FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_tax ORDER BY l_orderkey) = 1")
def spline_stiff_is_line(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    model = Glm("gaussian", [Spline("l_tax", kind="cr", n_knots=4, discrete=True, lambda_policy=LambdaPolicy.fixed(3e9))]).fit(df, "l_extendedprice")
    return df.select("l_tax").distinct().withColumn("mu", F.round(model.mean(), 0))


@query("SELECT l_returnflag, round(avg(l_extendedprice), 3) AS mu FROM lineitem GROUP BY 1")
def polynomial_saturated(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumn("code", F.ascii("l_returnflag").cast("double"))
    model = Glm("gaussian", [Polynomial("code", 2)]).fit(df, "l_extendedprice")
    return df.select("l_returnflag", "code").distinct().select("l_returnflag", F.round(model.mean(), 3).alias("mu"))


@query(f"WITH {COUNTS}, t AS (SELECT o_orderpriority, sum(y) AS s, avg(y) AS m, count(*) AS n FROM counts GROUP BY 1), b AS (SELECT s, m FROM t ORDER BY n DESC, o_orderpriority LIMIT 1) SELECT t.o_orderpriority AS level, round(ln(t.m / b.m), 6) AS log_relativity, CASE WHEN t.s = b.s THEN 0 ELSE round(sqrt(1 / t.s + 1 / b.s), 6) END AS se_log_relativity FROM t, b")
def relativities_with_se(spark, sf_dir):
    model = Glm("poisson", [Categorical("o_orderpriority")]).fit(counts(spark, sf_dir), "y")
    return model.relativities(spark, "o_orderpriority").select("level", r6("log_relativity").alias("log_relativity"), r6("se_log_relativity").alias("se_log_relativity"))


@query(f"WITH {COUNTS}, g AS (SELECT avg(y) AS m, count(*) AS n FROM counts), b AS (SELECT o_orderpriority AS base FROM counts GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), s AS (SELECT o_orderpriority, sum(y - m) AS u FROM counts, g, b WHERE o_orderpriority != base GROUP BY 1) SELECT round(sqrt(sum(u * u)) / (2 * any_value(n)), 8) AS lambda_max FROM s, g")
def lambda_max(spark, sf_dir):
    top = Glm("poisson", [Categorical("o_orderpriority")], penalty=solve.GroupLasso()).lambda_max(counts(spark, sf_dir), "y")
    return spark.createDataFrame([(round(top, 8),)], "lambda_max double")


@query(f"WITH {COUNTS}, g AS (SELECT avg(y) AS m FROM counts) SELECT o_orderpriority, round(any_value(m), 6) AS mu FROM counts, g GROUP BY 1")
def lasso_at_lambda_max(spark, sf_dir):
    df = counts(spark, sf_dir)
    spec = Glm("poisson", [Categorical("o_orderpriority")])
    top = spec.lambda_max(df, "y")
    return level_means(df, Glm("poisson", spec.terms, penalty=solve.GroupLasso(top * 1.0001)), ["o_orderpriority"], "y")


@query(f"WITH {SCORED} SELECT 'o_orderpriority' AS term, round(sum(w * ln(mu) * ln(mu)) / sum(w) - (sum(w * ln(mu)) / sum(w)) ** 2, 8) AS variance_eta FROM scored")
def term_importance(spark, sf_dir):
    df = counts(spark, sf_dir)
    return Glm("poisson", [Categorical("o_orderpriority")]).fit(df, "y").term_importance(df, "w").select("term", F.round("variance_eta", 8).alias("variance_eta"))


@query(f"WITH {SCORED}, g AS (SELECT avg(y) AS m FROM counts) SELECT 'o_orderpriority' AS feature, round(sum(2 * y * ln(mu / m)), 4) AS delta_deviance, 4 AS delta_df FROM scored, g")
def drop_one(spark, sf_dir):
    df = counts(spark, sf_dir)
    out = Glm("poisson", [Categorical("o_orderpriority")]).fit(df, "y").drop1(df, "y")
    return out.select("feature", F.round("delta_deviance", 4).alias("delta_deviance"), F.round("delta_df").cast("int").alias("delta_df"))


@query(f"WITH {COUNTS}, m AS (SELECT f, o_orderpriority, avg(y) AS mu, count(*) AS n FROM counts, (SELECT unnest(range(4)) AS f) WHERE o_orderkey % 4 != f GROUP BY 1, 2), t AS (SELECT f, sum(n)::BIGINT AS n_train FROM m GROUP BY 1), d AS (SELECT f, count(*) AS n_test, avg(2 * (y * ln(y / mu) - (y - mu))) AS deviance FROM counts c JOIN m ON m.o_orderpriority = c.o_orderpriority AND m.f = c.o_orderkey % 4 GROUP BY 1) SELECT f::VARCHAR AS fold, n_train, n_test, round(deviance, 6) AS deviance FROM t JOIN d USING (f)")
def cross_validation(spark, sf_dir):
    df = counts(spark, sf_dir).withColumn("fold", (F.col("o_orderkey") % 4).cast("int"))
    cv = select.cross_validate(Glm("poisson", [Categorical("o_orderpriority")]), df, "y", "fold")
    return cv.folds.select("fold", "n_train", "n_test", r6("deviance").alias("deviance"))


@query(f"WITH {SCORED} SELECT o_orderpriority, round(sum(mu), 4) AS fitted, round(sum(y), 4) AS observed FROM scored GROUP BY 1")
def score_balance(spark, sf_dir):
    df = counts(spark, sf_dir)
    model = Glm("poisson", [Categorical("o_orderpriority"), Spline("o_totalprice", n_knots=4)]).fit(df, "y")
    return model.predict(df, name="mu").groupBy("o_orderpriority").agg(F.round(F.sum("mu"), 4).alias("fitted"), F.round(F.sum("y"), 4).alias("observed"))


# -- validation tables -----------------------------------------------------------------------------------------------
def _bins(score: str, weight: str, n: int, order: str, source: str = "scored") -> str:
    return f"binned AS (SELECT *, least(greatest(ceil(sum({weight}) OVER (ORDER BY {score}, {order} ROWS UNBOUNDED PRECEDING) * {n} / sum({weight}) OVER ()), 1), {n})::BIGINT AS bin FROM {source})"


SCORED9 = SCORED + ", nine AS (SELECT * REPLACE (round(mu, 9) AS mu) FROM scored)"


@query(f"WITH {SCORED9}, {_bins('mu', 'w', 10, 'o_orderkey', 'nine')} SELECT bin, round(sum(w) / sum(sum(w)) OVER (), 6) AS exposure_share, round(sum(w * y) / sum(w), 6) AS observed, round(sum(w * mu) / sum(w), 6) AS predicted, round(sum(w * y) / sum(w * mu), 6) AS obs_pred_ratio FROM binned GROUP BY bin")
def lift_chart(spark, sf_dir):
    return rounded(charts.lift(scored(spark, sf_dir), "y", "mu", "w", ties=["o_orderkey"]))


@query("WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_quantity AS w, l_extendedprice AS y, 1000 + 900 * l_quantity AS model, 30000 + 100000 * l_discount AS cur FROM lineitem), t AS (SELECT *, model / cur AS s FROM s), " + _bins("s", "w", 5, "l_orderkey, l_linenumber, l_partkey, l_suppkey, y, l_shipdate", "t") + ", g AS (SELECT bin, count(*) AS n_rows, sum(w) AS e, sum(w * y) AS ty, sum(w * model) AS tm, sum(w * cur) AS tc, min(s) AS lo, median(s) AS mid, max(s) AS hi FROM binned GROUP BY 1) SELECT bin, n_rows, round(e, 6) AS exposure_sum, round(e / sum(e) OVER (), 6) AS exposure_share, round(ty, 2) AS target_sum, round(ty / e, 4) AS actual_avg, round(tm / e, 4) AS model_avg, round(tc / e, 4) AS current_avg, round((ty / e) / (sum(ty) OVER () / sum(e) OVER ()), 6) AS actual_index, round((tm / e) / (sum(tm) OVER () / sum(e) OVER ()), 6) AS model_index, round((tc / e) / (sum(tc) OVER () / sum(e) OVER ()), 6) AS current_index, round(lo, 6) AS sort_score_min, round(mid, 6) AS sort_score_median, round(hi, 6) AS sort_score_max FROM g")
def double_lift_chart(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").withColumns({"model": 1000 + 900 * F.col("l_quantity"), "cur": 30000 + 100000 * F.col("l_discount")})
    out = charts.double_lift(df, "l_extendedprice", "model", "cur", "l_quantity", n_bins=5, ties=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])
    digits = {"target_sum": 2, "actual_avg": 4, "model_avg": 4, "current_avg": 4}
    return out.select(F.col("bin").cast("long").alias("bin"), "n_rows", *(F.round(c, digits.get(c, 6)).alias(c) for c in out.columns[2:]))


@query(f"WITH {SCORED9}, {_bins('o_totalprice', 'w', 8, 'o_orderkey', 'nine')} SELECT bin, round(sum(w) / sum(sum(w)) OVER (), 6) AS exposure_share, round(sum(w * y) / sum(w), 6) AS observed, round(sum(w * mu) / sum(w), 6) AS predicted FROM binned GROUP BY bin")
def loss_ratio_chart(spark, sf_dir):
    return rounded(charts.loss_ratio(scored(spark, sf_dir), "y", "mu", "w", n_bins=8, feature="o_totalprice", ties=["o_orderkey"]))


_LORENZ = ", model AS (SELECT sum(sum(w)) OVER (ORDER BY mu) / sum(sum(w)) OVER () AS x, sum(sum(w * y)) OVER (ORDER BY mu) / sum(sum(w * y)) OVER () AS v, sum(w) / sum(sum(w)) OVER () AS dx, sum(w * y) / sum(sum(w * y)) OVER () AS dv FROM nine GROUP BY mu), perfect AS (SELECT sum(sum(w)) OVER (ORDER BY y) / sum(sum(w)) OVER () AS x, sum(sum(w * y)) OVER (ORDER BY y) / sum(sum(w * y)) OVER () AS v, sum(w) / sum(sum(w)) OVER () AS dx, sum(w * y) / sum(sum(w * y)) OVER () AS dv FROM nine GROUP BY y)"


@query(f"WITH {SCORED9}{_LORENZ}, p AS (SELECT 0.0 AS x, 0.0 AS v UNION ALL SELECT x, v FROM perfect), q AS (SELECT m.x, any_value(m.v) AS v, max(a.x) AS ax, max(a.v) AS av, min(b.x) AS bx, min(b.v) AS bv FROM model m JOIN p a ON a.x <= m.x JOIN p b ON b.x >= m.x GROUP BY m.x) SELECT round(x, 6) AS cum_exposure_share, round(x, 6) AS cum_loss_share_ordered, round(v, 6) AS cum_loss_share_model, round(CASE WHEN bx > ax THEN av + (x - ax) / (bx - ax) * (bv - av) ELSE av END, 6) AS cum_loss_share_perfect FROM q UNION ALL SELECT 0, 0, 0, 0")
def lorenz_curve(spark, sf_dir):
    return rounded(charts.lorenz(scored(spark, sf_dir), "y", "mu", "w"))


@query(f"WITH {SCORED9}{_LORENZ}, a AS (SELECT 1 - sum(dx * (2 * v - dv)) AS g FROM model), b AS (SELECT 1 - sum(dx * (2 * v - dv)) AS h FROM perfect) SELECT round(g, 6) AS gini_model, round(h, 6) AS gini_perfect, round(g / h, 6) AS gini_ratio FROM a, b")
def gini(spark, sf_dir):
    return rounded(charts.gini(scored(spark, sf_dir), "y", "mu", "w"))


@query(f"WITH {SCORED9}, r AS (SELECT w, sum(w * y) OVER (ORDER BY mu, o_orderkey ROWS UNBOUNDED PRECEDING) AS c, sum(w * y) OVER () AS l, sum(w) OVER () AS t FROM nine) SELECT round(1 - 2 * sum(w * c) / (any_value(t) * any_value(l)), 6) AS gini_cv FROM r")
def gini_score(spark, sf_dir):
    return rounded(charts.gini_cv(scored(spark, sf_dir), "y", "mu", "w", ties=["o_orderkey"]))


@query(f"WITH {SCORED9}, {_bins('mu', 'w', 20, 'o_orderkey', 'nine')} SELECT bin, round(sum(w * y) / sum(w), 6) AS observed, round(sum(w * mu) / sum(w), 6) AS predicted FROM binned GROUP BY bin")
def calibration_points(spark, sf_dir):
    return rounded(charts.calibration(scored(spark, sf_dir), "y", "mu", "w", ties=["o_orderkey"]))


@query(f"WITH {COUNTS}, s AS (SELECT *, 1 + (o_orderkey % 5)::DOUBLE AS w FROM counts), {_bins('o_totalprice', 'w', 10, 'o_orderkey', 's')} SELECT bin, round(max(o_totalprice), 4) AS edge, count(*) AS n FROM binned GROUP BY bin")
def weighted_quantile_bins(spark, sf_dir):
    rows = charts.equal_weight_bins(counts(spark, sf_dir), F.col("o_totalprice"), F.col("w"), 10, ["o_orderkey"])
    return rows.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.round(F.max("o_totalprice"), 4).alias("edge"), F.count("*").alias("n"))


@query("WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), s AS (SELECT round(lo + (least(greatest(floor((o_totalprice - lo) / ((hi - lo) / 64)), 0), 63) + 0.5) * ((hi - lo) / 64), 4) AS centre FROM orders, r) SELECT centre, count(*) AS n FROM s GROUP BY 1")
def discretised_column(spark, sf_dir):
    return charts.discretised(read(spark, sf_dir, "orders"), "o_totalprice", 64).groupBy(F.round("o_totalprice_bin", 4).alias("centre")).agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT i::BIGINT AS i, round(lo + (hi - lo) * i / 12, 4) AS edge FROM r, range(13) t(i)")
def uniform_edges(spark, sf_dir):
    edges = charts.uniform_edges(read(spark, sf_dir, "lineitem"), "l_extendedprice", 12)
    return spark.createDataFrame([(i, round(e, 4)) for i, e in enumerate(edges)], "i long, edge double")


# -- adequacy --------------------------------------------------------------------------------------------------------
@query(f"WITH {SCORED9} SELECT sum(CASE WHEN y - 1 = 0 THEN 1 ELSE 0 END)::DOUBLE AS observed_zeros, round(sum(exp(-(mu - 1))), 3) AS expected_zeros, round((sum(CASE WHEN y - 1 = 0 THEN 1 ELSE 0 END) - sum(exp(-(mu - 1)))) / count(*), 6) AS zero_inflation_index, round(sum(CASE WHEN y - 1 = 0 THEN 1 ELSE 0 END) / sum(exp(-(mu - 1))), 6) AS ratio FROM nine")
def zero_inflation(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"y": F.col("y") - 1, "mu": F.col("mu") - 1})
    return rounded(adequacy.zero_inflation(df, "y", "mu", families.poisson())).withColumn("expected_zeros", F.round("expected_zeros", 3))


@query(f"WITH {SCORED9}, s AS (SELECT sum((CASE WHEN y - 1 = 0 THEN 1 ELSE 0 END - exp(-(mu - 1))) / exp(-(mu - 1))) AS u, sum((1 - exp(-(mu - 1))) / exp(-(mu - 1))) - sum(y - 1) AS v FROM nine) SELECT round(u * u / v, 4) AS statistic, CASE WHEN u > 0 THEN 'inflated' ELSE 'deflated' END AS direction FROM s")
def score_test_zero_inflation(spark, sf_dir):
    df = scored(spark, sf_dir).withColumns({"y": F.col("y") - 1, "mu": F.col("mu") - 1})
    return adequacy.score_test_zi(df, "y", "mu").select(F.round("statistic", 4).alias("statistic"), "direction")


@query(f"WITH {SCORED9}, z AS (SELECT mu AS m, ((y - mu) ** 2 - y) / mu AS z FROM nine), s AS (SELECT sum(z * m) / sum(m * m) AS a, sum(z * z) AS zz, sum(z * m) AS zm, sum(m * m) AS mm, count(*) AS n FROM z) SELECT round(a / sqrt((zz - a * zm) / (n - 1) / mm), 5) AS statistic, round(a, 6) AS alpha_hat FROM s")
def dispersion_test(spark, sf_dir):
    out = adequacy.dispersion_test(scored(spark, sf_dir), "y", "mu")
    return out.select(F.round("statistic", 5).alias("statistic"), r6("alpha_hat").alias("alpha_hat"))


@query(f"WITH {SCORED9}, o AS (SELECT o_orderstatus, avg(y) AS nu FROM counts GROUP BY 1), d AS (SELECT y * ln(mu / round(nu, 9)) - (mu - round(nu, 9)) AS d FROM nine JOIN o USING (o_orderstatus)), s AS (SELECT avg(d) AS m, stddev_pop(d) AS omega, count(*) AS n FROM d) SELECT round((n * m - 2) / (sqrt(n) * omega), 5) AS statistic, round(m, 8) AS mean_diff, round(omega, 8) AS omega FROM s")
def vuong_test(spark, sf_dir):
    f = families.poisson()
    df = counts(spark, sf_dir)
    a = Glm("poisson", [Categorical("o_orderpriority")]).fit(df, "y")
    b = Glm("poisson", [Categorical("o_orderstatus")]).fit(df, "y")
    ll = lambda m: f.log_likelihood(F.col("y"), F.round(m.mean(), 9), F.lit(1.0))
    out = adequacy.vuong_test(df, ll(a), ll(b), a.fit.edf, b.fit.edf)
    return out.select(F.round("statistic", 5).alias("statistic"), F.round("mean_diff", 8).alias("mean_diff"), F.round("omega", 8).alias("omega"))


# -- smoothing, paths, shapes and profiles, where a closed form is known -----------------------------------------------
# x takes three values, so a natural cubic with knots there has a line and one bend. With F the bend's sum of squares over
# the residual variance, restricted likelihood keeps the share 1 - 1 / F of it.
_REML = """WITH d AS (SELECT floor(l_quantity / 17)::DOUBLE AS x, l_extendedprice / 1000 + CASE WHEN floor(l_quantity / 17) = 1 THEN 2 ELSE 0 END AS y FROM lineitem),
r AS (SELECT regr_intercept(y, x) AS a, regr_slope(y, x) AS b, count(*) AS n FROM d),
c AS (SELECT x, avg(y) AS m, count(*) AS k, sum(y * y) - count(*) * avg(y) * avg(y) AS within FROM d GROUP BY x),
f AS (SELECT sum(k * (m - a - b * x) ** 2) / (sum(within) / (any_value(n) - 3)) AS f FROM c, r)
SELECT x, round(a + b * x + greatest(1 - 1 / f, 0) * (m - a - b * x), 4) AS mu FROM c, r, f"""


@query(_REML)
def reml_smooth(spark, sf_dir):
    x = F.floor(F.col("l_quantity") / 17).cast("double")
    df = read(spark, sf_dir, "lineitem").select(x.alias("x"), (F.col("l_extendedprice") / 1000 + F.when(x == 1, 2.0).otherwise(0.0)).alias("y"))
    model = Glm("gaussian", [Spline("x", kind="cr_cardinal", n_knots=1, discrete=True)]).fit_reml(df, "y")
    return df.select("x").distinct().withColumn("mu", F.round(model.mean(), 4))


@query(
    f"WITH {COUNTS}, t AS (SELECT o_orderpriority, sum(y) AS s, avg(y) AS m, count(*) AS n FROM counts GROUP BY 1), b AS (SELECT m AS base FROM t ORDER BY n DESC, o_orderpriority LIMIT 1) "
    "SELECT 'o_orderpriority' AS term, 4.0 AS edf, 4.0 AS ref_df, round(sum(s * ln(m / base) ** 2) - sum(s * ln(m / base)) ** 2 / sum(s), 5) AS statistic FROM t, b"
)
def factor_test(spark, sf_dir):
    model = Glm("poisson", [Categorical("o_orderpriority")]).fit(counts(spark, sf_dir), "y")
    t = model.smooth_test("o_orderpriority")
    return spark.createDataFrame([(t["term"], round(t["edf"], 6), round(t["ref_df"], 6), round(t["statistic"], 5))], "term string, edf double, ref_df double, statistic double")


# A smooth that is free of penalty on three values has two whole directions: the F test of three means.
@query(
    "WITH d AS (SELECT floor(l_quantity / 17)::DOUBLE AS x, l_extendedprice / 1000 AS y FROM lineitem), c AS (SELECT x, avg(y) AS m, count(*) AS k, sum(y * y) - count(*) * avg(y) * avg(y) AS within FROM d GROUP BY x), g AS (SELECT avg(y) AS a, count(*) AS n FROM d) "
    "SELECT 'x' AS term, 2.0 AS edf, 2.0 AS ref_df, round(sum(k * (m - a) ** 2) / (sum(within) / (any_value(n) - 3)), 2) AS statistic FROM c, g"
)
def reml_summary(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") / 17).cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    model = Glm("gaussian", [Spline("x", kind="cr_cardinal", n_knots=1, discrete=True, lambda_policy=LambdaPolicy.off())]).fit_reml(df, "y")
    t = model.smooth_test("x")
    return spark.createDataFrame([(t["term"], round(t["edf"], 6), round(t["ref_df"], 6), round(t["statistic"], 2))], "term string, edf double, ref_df double, statistic double")


@query("SELECT l_discount, l_tax, round(avg(l_extendedprice), 2) AS mu FROM lineitem GROUP BY 1, 2")
def tensor_surface(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    a, b = Spline("l_discount", kind="cr_cardinal", n_knots=9, discrete=True), Spline("l_tax", kind="cr_cardinal", n_knots=7, discrete=True)
    model = Glm("gaussian", [a, b, TensorInteraction(a, b)], spline_penalty=0.0).fit(df, "l_extendedprice")
    return df.select("l_discount", "l_tax").distinct().withColumn("mu", F.round(model.mean(), 2))


@query(f"WITH {COUNTS}, g AS (SELECT avg(y) AS m FROM counts), l AS (SELECT *, avg(y) OVER (PARTITION BY o_orderpriority) AS mu FROM counts) SELECT 1::BIGINT AS step, round(sum(2 * (y * ln(y / m) - (y - m))), 3) AS deviance, 1.0 AS edf FROM counts, g UNION ALL SELECT 2, round(sum(2 * (y * ln(y / mu) - (y - mu))), 3), 5.0 FROM l")
def lasso_path(spark, sf_dir):
    spec = Glm("poisson", [Categorical("o_orderpriority")], penalty=solve.GroupLasso())
    df = counts(spark, sf_dir)
    top = spec.lambda_max(df, "y")
    out = spec.fit_path(df, "y", lambda_seq=[1e-9, top * 1.0001])
    return out.select(F.when(F.col("lambda") > 1e-8, 1).otherwise(2).cast("long").alias("step"), F.round("deviance", 3).alias("deviance"), F.round("edf", 4).alias("edf"))


@query(
    f"WITH {COUNTS}, m AS (SELECT *, avg(y) OVER (PARTITION BY o_orderpriority) AS mu, 1.0::DOUBLE / count(*) OVER (PARTITION BY o_orderpriority) AS h FROM counts), p AS (SELECT *, (y - mu) / sqrt(mu * (1 - h)) AS sp FROM m) "
    "SELECT o_orderkey, round(mu, 6) AS mu, round(h, 8) AS leverage, round(sp, 6) AS std_pearson_residual, round(sp * sp * h / ((1 - h) * 5), 9) AS cooks_distance, round(sign(y - mu) * sqrt(greatest(2 * (y * ln(y / mu) - (y - mu)), 0)) / sqrt(1 - h), 5) AS std_deviance_residual FROM p"
)
def influence(spark, sf_dir):
    df = counts(spark, sf_dir)
    out = Glm("poisson", [Categorical("o_orderpriority")]).fit(df, "y").influence(df, "y")
    digits = {"mu": 6, "leverage": 8, "std_pearson_residual": 6, "cooks_distance": 9, "std_deviance_residual": 5}
    return out.select("o_orderkey", *(F.round(c, n).alias(c) for c, n in digits.items()))


_PMF = "list_sum(list_transform(range(0, {k}), lambda j: exp(-mu + j * ln(mu) - lgamma(j + 1))))"


@query(f"WITH {SCORED9} SELECT o_orderkey, round(coalesce({_PMF.format(k='y::INT')}, 0), 6) AS least, round({_PMF.format(k='y::INT + 1')}, 6) AS most, true AS inside FROM nine")
def quantile_residuals(spark, sf_dir):
    """The randomised residual of each row lies between the normal quantiles of P(Y < y) and P(Y <= y)."""
    df = adequacy.quantile_residuals(adequacy.with_cdf_bounds(scored(spark, sf_dir), "y", "mu", families.poisson()), "y", "mu", families.poisson())
    u = links.NAMED["probit"]().inverse(F.col("residual"))
    return df.select("o_orderkey", F.round("cdf_below", 6).alias("least"), F.round("cdf_upto", 6).alias("most"), ((u >= F.col("cdf_below") - 1e-6) & (u <= F.col("cdf_upto") + 1e-6)).alias("inside"))


@query("WITH d AS (SELECT l_extendedprice / 1000 AS y, l_returnflag FROM lineitem), m AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS mu FROM d) SELECT l_returnflag, round(avg(CASE WHEN y > mu THEN 1.0 ELSE 0.0 END), 6) AS above, round(max((y - mu) / 20), 4) AS most FROM m GROUP BY 1")
def gaussian_quantile_residuals(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("y"), "l_returnflag")
    mu = Glm("gaussian", [Categorical("l_returnflag")]).fit(df, "y").predict(df, name="mu")
    out = adequacy.quantile_residuals(mu, "y", "mu", families.gaussian(), phi=400.0)
    return out.groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("residual") > 0, 1.0).otherwise(0.0)), 6).alias("above"), F.round(F.max("residual"), 4).alias("most"))


@query("SELECT floor((l_quantity - 1) / 10)::BIGINT AS band, round(avg(l_extendedprice / 1000 + 5 * floor((l_quantity - 1) / 10)), 2) AS mu FROM lineitem GROUP BY 1")
def monotone_fit(spark, sf_dir):
    """Means that rise already: a monotone smooth with room enough passes through them."""
    band = F.floor((F.col("l_quantity") - 1) / 10).cast("double")
    df = read(spark, sf_dir, "lineitem").select(band.alias("band"), (F.col("l_extendedprice") / 1000 + 5 * band).alias("y"))
    spec = Glm("gamma", [Spline("band", kind="ps", n_knots=3, discrete=True, constraint=Constraint.fit.increasing, lambda_policy=LambdaPolicy.fixed(1e-7))], link="log", tol=1e-12)
    return df.select("band").distinct().select(F.col("band").cast("long").alias("band"), F.round(spec.fit(df, "y").mean(), 2).alias("mu"))


@query("SELECT floor((l_quantity - 1) / 10)::BIGINT AS band, round(avg(l_extendedprice / 1000 + 5 * floor((l_quantity - 1) / 10)) OVER (), 3) AS mu FROM lineitem QUALIFY row_number() OVER (PARTITION BY floor((l_quantity - 1) / 10)) = 1")
def monotone_fit_against(spark, sf_dir):
    """Means that rise under a falling shape: the best is their common mean."""
    band = F.floor((F.col("l_quantity") - 1) / 10).cast("double")
    df = read(spark, sf_dir, "lineitem").select(band.alias("band"), (F.col("l_extendedprice") / 1000 + 5 * band).alias("y"))
    spec = Glm("gaussian", [Spline("band", kind="cr", n_knots=3, discrete=True, constraint=Constraint.fit.decreasing)])
    return df.select("band").distinct().select(F.col("band").cast("long").alias("band"), F.round(spec.fit(df, "y").mean(), 3).alias("mu"))


@query("SELECT d AS direction, CASE WHEN d = 'increasing' THEN b < 0 ELSE b > 0 END AS violated_before, 0.0 AS violation_after FROM (SELECT regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem), (SELECT unnest(['increasing', 'decreasing']) AS d)")
def monotone_repair(spark, sf_dir):
    """A smooth so stiff that it is the regression line: all rows together weigh 1, so it is as stiff at every size."""
    df, out = read(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000), None
    df = df.withColumn("w", F.lit(1 / max(df.count(), 1)))
    for shape in (Constraint.postfit.increasing, Constraint.postfit.decreasing):
        term = Spline("l_quantity", kind="cr", n_knots=4, discrete=True, constraint=shape, lambda_policy=LambdaPolicy.fixed(3e9))
        report = Glm("gaussian", [term]).fit(df, "y", "w").monotonised(df)[1]
        part = report.select("direction", (F.col("max_violation_before") > 1e-6).alias("violated_before"), F.abs(F.round("max_violation_after", 6)).alias("violation_after"))
        out = part if out is None else out.unionByName(part)
    return out


# One factor: the means do not depend on theta, which is then found on a grid around each of two decades.
@query(
    "WITH d AS (SELECT user_id, count(*)::DOUBLE AS y, (user_id % 3)::VARCHAR AS kind FROM events GROUP BY user_id), m AS (SELECT y, avg(y) OVER (PARTITION BY kind) AS mu FROM d), c AS (SELECT y, mu, count(*) AS n FROM m GROUP BY 1, 2), "
    "g AS (SELECT exp(ln(0.1) + i * (ln(50) - ln(0.1)) / 4000) AS t FROM range(4001) r(i)), l AS (SELECT t, sum(n * (lgamma(y + t) - lgamma(t) - lgamma(y + 1) + t * ln(t / (t + mu)) + y * ln(mu / (t + mu)))) AS ll FROM c, g GROUP BY t) SELECT round(-max(ll), 2) AS nll FROM l"
)
def theta_profile(spark, sf_dir):
    df = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").cast("double").alias("y")).withColumn("kind", (F.col("user_id") % 3).cast("string"))
    _, profile = Glm("poisson", [Categorical("kind")]).estimate_theta(df, "y")
    return spark.createDataFrame([(round(profile.nll, 2),)], "nll double")


@query(
    "WITH d AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN value / 100 ELSE 0.0 END AS y FROM events), m AS (SELECT *, avg(y) OVER (PARTITION BY event_type) AS mu FROM d), p AS (SELECT i + 1 AS step, 1.2 + 0.15 * i AS p FROM range(5) r(i)), k AS (SELECT count(DISTINCT event_type) AS k, count(*) AS n FROM d), "
    "f AS (SELECT step, p, sum((y - mu) ** 2 / mu ** p) / any_value(n - k) AS phi FROM m, p, k GROUP BY 1, 2), "
    "z AS (SELECT f.*, y, mu, (2 - p) / (p - 1) AS a, (2 - p) / (p - 1) * ln(y / (p - 1)) - (1 + (2 - p) / (p - 1)) * ln(phi) - ln(2 - p) AS lz FROM m, f WHERE y > 0), "
    "w AS (SELECT step, y, mu, p, phi, list_transform(range(1, 400), lambda j: j * lz - lgamma(j + 1) - lgamma(a * j)) AS t FROM z), "
    "l AS (SELECT step, list_max(t) + ln(list_sum(list_transform(t, lambda x: exp(x - list_max(t))))) - ln(y) + (y * mu ** (1 - p) / (1 - p) - mu ** (2 - p) / (2 - p)) / phi AS l FROM w UNION ALL SELECT step, -(mu ** (2 - p)) / (phi * (2 - p)) FROM m, f WHERE y = 0) "
    "SELECT step, round(any_value(p), 4) AS p, round(any_value(phi), 5) AS phi, round(-sum(l), 1) AS nll FROM l JOIN f USING (step) GROUP BY step"
)
def tweedie_power(spark, sf_dir):
    df = read(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, F.col("value") / 100).otherwise(0.0).alias("y"))
    _, profile = Glm(families.tweedie(1.5), [Categorical("event_type")], tol=1e-12).estimate_p(df, "y", method="grid", grid=5, bounds=(1.2, 1.8))
    return spark.createDataFrame([(t["step"], round(t["p"], 4), round(t["phi"], 5), round(t["nll"], 1)) for t in profile.trace], "step long, p double, phi double, nll double")


_BAND = "least(greatest(ceil((l_quantity - lo) * 7 / (hi - lo)) - 1, 0), 6)"


@query(f"WITH r AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, regr_slope(l_extendedprice / 100000 + 0.01 * l_quantity, l_quantity) AS b, avg(l_quantity) AS m FROM lineitem) SELECT round(lo + {_BAND} * (hi - lo) / 7, 6) AS bin_from, count(*) AS n_obs, round(any_value(b) * (avg(l_quantity) - any_value(m)), 3) AS log_relativity FROM lineitem, r GROUP BY 1")
def discretization_impact(spark, sf_dir):
    """A smooth that is held to a line, cut into seven equal bins."""
    df = read(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 100000 + 0.01 * F.col("l_quantity"))
    model = Glm("gaussian", [Spline("l_quantity", kind="cr", n_knots=4, discrete=True, lambda_policy=LambdaPolicy.fixed(3e9))]).fit(df, "y")
    table = model.discretization_impact(df, "y", n_bins=7, strategy="uniform")[0]["l_quantity"]
    return table.select(F.round("bin_from", 6).alias("bin_from"), "n_obs", F.round("log_relativity", 3).alias("log_relativity"))


_KNOT = "least(greatest(ceil((o_totalprice - lo) * 13 / (hi - lo)) - 1, 0), 12)::BIGINT"


@query(f"WITH o AS (SELECT o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)), r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM o) SELECT {_KNOT} AS i, round(any_value((hi - lo) / 13), 4) AS spacing, round(count(*)::DOUBLE / any_value(n), 6) AS mass FROM o, r GROUP BY 1")
def spline_redundancy(spark, sf_dir):
    df = counts(spark, sf_dir)
    report = Glm("poisson", [Spline("o_totalprice", n_knots=12)]).fit(df, "y").spline_redundancy(df)
    each = report.select(F.posexplode(F.arrays_zip("knot_spacing", "support_mass")).alias("i", "v"))
    return each.filter("v.support_mass > 0").select(F.col("i").cast("long").alias("i"), F.round("v.knot_spacing", 4).alias("spacing"), F.round("v.support_mass", 6).alias("mass"))


@query(
    "WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), q AS (SELECT x, (row_number() OVER (ORDER BY x) - 0.5) / count(*) OVER () AS spot FROM (SELECT DISTINCT l_quantity::DOUBLE AS x FROM lineitem)), n AS (SELECT x, spot, lead(x) OVER (ORDER BY x) AS x1, lead(spot) OVER (ORDER BY x) AS spot1 FROM q), t AS (SELECT i, i / 6.0 AS t FROM range(1, 6) r(i)) "
    "SELECT 'l_extendedprice' AS feature, 'ns' AS kind, i::BIGINT AS i, round(lo + (hi - lo) * t, 3) AS knot FROM r, t UNION ALL SELECT 'l_quantity', 'ps', i, round(x + (t - spot) / (spot1 - spot) * (x1 - x), 3) FROM n JOIN t ON spot <= t AND t < spot1"
)
def knot_summary(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem")
    terms = [Spline("l_extendedprice", kind="ns", n_knots=5), Spline("l_quantity", knot_strategy="quantile", n_knots=5, discrete=True)]
    found = Glm("gaussian", terms).fit(df, "l_tax").knot_summary(spark)
    each = found.select("feature", "kind", F.posexplode("interior_knots").alias("i", "knot"))
    return each.select("feature", "kind", (F.col("i") + 1).cast("long").alias("i"), F.round("knot", 3).alias("knot"))


@query(f"WITH {COUNTS} SELECT 'o_orderpriority' AS term, 'Categorical' AS kind, count(DISTINCT o_orderpriority) - 1 AS size FROM counts UNION ALL SELECT 'o_orderstatus', 'Categorical', count(DISTINCT o_orderstatus) - 1 FROM counts UNION ALL SELECT 'o_totalprice', 'Spline', 13 UNION ALL SELECT 'o_orderkey', 'Numeric', 1")
def detected_terms(spark, sf_dir):
    """Terms by column type, with the coefficients that each has after fitting."""
    df = counts(spark, sf_dir).drop("w")
    model = Glm("poisson", detect(df, ["o_totalprice"], skip=["y"])).fit(df, "y")
    return spark.createDataFrame([(t.name, type(t).__name__, t.size) for t in model.design.terms], "term string, kind string, size long")


_PHI = "0.5 + exp(-e * e / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 40), lambda k: sign(e) * exp((2 * k + 1) * ln(abs(e) + 1e-300) - list_sum(list_transform(range(0, k + 1), lambda j: ln(2 * j + 1))))))"


@query(f"SELECT l_discount, round({_PHI}, 5) AS mu, round((1.5 + e) ** 0.7, 6) AS power_eta FROM (SELECT DISTINCT l_discount, 31 * l_discount - 1.05 AS e FROM lineitem)")
def probit_and_power_links(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem").select("l_discount").distinct().withColumn("e", 31 * F.col("l_discount") - 1.05)
    probit, power = links.NAMED["probit"](), links.Power(0.7)
    return df.select("l_discount", F.round(probit.inverse(F.col("e")), 5).alias("mu"), r6(power.link(1.5 + F.col("e"))).alias("power_eta"))


# -- the same fits with all rows in Spark: one Arrow pass an iteration, no collected cells -------------------------------
OVER_ROWS = (
    "poisson_one_factor", "poisson_weighted", "poisson_offset", "gamma_saturated", "gaussian_line", "gaussian_slopes_by_level", "binomial_one_factor", "nb2_one_factor", "tweedie_one_factor", "collapsed_levels", "ordered_steps",
    "spline_interpolates", "spline_stiff_is_line", "polynomial_saturated", "relativities_with_se", "lambda_max", "lasso_at_lambda_max", "lasso_path", "score_balance", "reml_smooth", "tensor_surface", "monotone_fit", "monotone_fit_against", "factor_test",
)


def _over_rows(name: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with frame.rows_only():
            return QUERIES[name](spark, sf_dir)

    return run


for _name in OVER_ROWS:
    QUERIES[f"{_name}_rows"] = _over_rows(_name)
    ORACLE_SQL[f"{_name}_rows"] = ORACLE_SQL[_name]
