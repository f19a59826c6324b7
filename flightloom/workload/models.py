"""Queries that fit models. Trees differ between engines, so most of these have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import models, prepare
from ..operators.encode import one_hot
from ..plans.submission import submission as submit
from . import standins as s
from .registry import Registry
from .standins import q, rounded, sql
from .tracks import movements

REGISTRY = Registry()
_add = REGISTRY.add

_FEATURES = ["lines", "quantity", "discount", "tax", "o_orderstatus_F", "o_orderstatus_O", "o_orderstatus_P"]


def _table(spark, d):
    """One row per order with a priced target that depends on its lines."""
    lines = s.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("discount"),
        F.avg("l_tax").alias("tax"),
        F.sum("l_extendedprice").alias("target"),
    )
    orders = one_hot(s.read(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])
    table = orders.join(lines, "o_orderkey").withColumnRenamed("o_orderkey", "flightid")
    return prepare.assemble(table, _FEATURES).select("flightid", "target", "features")


def _halves(spark, d):
    split = prepare.with_split(_table(spark, d), "flightid")
    split = prepare.with_fold(split, "flightid", 3)
    return split.where("is_train"), split.where(~F.col("is_train"))


@_add(
    "linreg_fit",
    sql(
        f"""SELECT {q('regr_intercept(y, x)', 4, 'intercept')}, {q('regr_slope(y, x)', 4, 'slope')},
        {q('sqrt(regr_syy(y, x) * (1 - pow(corr(y, x), 2)) / count(*))', 3, 'rmse')} FROM t""",
        t="SELECT l_extendedprice AS y, l_quantity AS x FROM lineitem",
    ),
)
def linreg_fit(spark, d):
    lines = s.read(spark, d, "lineitem").select(F.col("l_extendedprice").alias("target"), "l_quantity")
    data = prepare.assemble(lines, ["l_quantity"])
    model = models.linear().fit(data)
    error = models.score(model.transform(data))
    out = spark.createDataFrame([(float(model.intercept), float(model.coefficients[0]), error)], "intercept double, slope double, rmse double")
    out = rounded(out.select("intercept", "slope"), 4).withColumn("rmse", F.lit(error))
    from .standins import r

    return out.withColumn("rmse", r("rmse", 3))


_SUBMISSION = {
    "rows": "SELECT flightid, origem = destino AS same, target, CAST(hora AS DOUBLE) AS x, CAST(CAST('0x' || substr(md5(flightid || '-42'), 1, 8) AS BIGINT) % 5 AS INT) AS fold FROM flights",
    "folds": "SELECT unnest(range(5)) AS k",
    "fits": "SELECT k, regr_intercept(target, x) AS a, regr_slope(target, x) AS b FROM rows, folds WHERE NOT same AND fold <> k GROUP BY k",
}


@_add(
    "submission",
    sql(
        f"""SELECT flightid AS "ID", {q('CASE WHEN same THEN 0.0 ELSE (SELECT avg(a) FROM fits) + (SELECT avg(b) FROM fits) * x END', 4, 'solution')} FROM rows""",
        "flights", **_SUBMISSION,
    ),
)
def submission(spark, d):
    flights = movements(spark, d).withColumn("hora", F.col("hora").cast("double"))
    solution, _ = submit(flights, flights, ["hora"], models.linear(), 5)
    return rounded(solution, 4)


@_add(
    "submission_error",
    sql(
        f"""SELECT {q('avg(e)', 3, 'mean_rmse')}, count(*) AS folds FROM (SELECT sqrt(avg(pow(target - a - b * x, 2))) AS e
        FROM rows JOIN fits ON fold = k WHERE NOT same GROUP BY k)""",
        "flights", **_SUBMISSION,
    ),
)
def submission_error(spark, d):
    flights = movements(spark, d).withColumn("hora", F.col("hora").cast("double"))
    return rounded(submit(flights, flights, ["hora"], models.linear(), 5)[1], 3)


@_add("gbt_cv")
def gbt_cv(spark, d):
    data = prepare.with_fold(_table(spark, d), "flightid", 3)
    held, _ = models.cross_fit(data, models.boosted(5), 3, "flightid")
    return rounded(held, 4)


@_add("gbt_until_flat")
def gbt_until_flat(spark, d):
    marked = _table(spark, d)
    marked = prepare.with_split(marked, "flightid").withColumn("is_validation", ~F.col("is_train"))
    model = models.boosted_until_flat(12).fit(marked)
    return marked.agg(F.count(F.lit(1)).alias("rows")).withColumn("trees", F.lit(model.getNumTrees))


@_add("model_compare")
def model_compare(spark, d):
    train, held_out = _halves(spark, d)
    candidates = {"linear": models.linear(), "boosted": models.boosted_shallow(), "forest": models.forest()}
    return rounded(models.compare(candidates, train, held_out), 4)


@_add("rf_stack")
def rf_stack(spark, d):
    train, held_out = _halves(spark, d)
    bases = {"linear": models.linear(), "boosted": models.boosted_shallow(), "forest": models.forest()}
    out = models.stack(train, held_out, bases, models.forest(), 3)
    return rounded(out.select("flightid", "target", "prediction"), 4)


@_add("grid_search")
def grid_search(spark, d):
    train, _ = _halves(spark, d)
    return models.grid_search(train, models.boosted_shallow(2), {"maxDepth": [2, 3], "stepSize": [0.1, 0.2]}, 3)


@_add("random_search")
def random_search(spark, d):
    train, held_out = _halves(spark, d)
    space = {"maxDepth": (2, 4), "subsamplingRate": (0.5, 1.0), "minInfoGain": (0.001, 0.1), "featureSubsetStrategy": (0.3, 1.0)}
    return models.random_search(train, held_out, models.boosted(2), space, 3)


@_add("feature_importance")
def feature_importance(spark, d):
    model = models.forest().fit(_table(spark, d))
    return models.importance(model, _FEATURES, spark)
