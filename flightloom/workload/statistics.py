"""Queries on table statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ml import explain, models
from ..operators import encode, stats
from . import standins as s
from .registry import Registry
from .standins import q, r, rounded, sql

REGISTRY = Registry()
_add = REGISTRY.add

_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _described(column: str, table: str) -> str:
    parts = {
        "mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})", "max": f"max({column})",
        "q25": f"quantile_cont({column}, 0.25)", "q50": f"quantile_cont({column}, 0.5)", "q75": f"quantile_cont({column}, 0.75)",
    }
    return f"{', '.join(q(f'CAST({e} AS DOUBLE)', 4, n) for n, e in parts.items())}"


@_add(
    "describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {_described(c, 'lineitem')} FROM lineitem""" for c in _NUMBERS
    ),
)
def describe(spark, d):
    return rounded(stats.describe(s.read(spark, d, "lineitem"), _NUMBERS), 4)


def _profiled(column: str, kind: str, numeric: bool) -> str:
    described = _described(column, "orders") if numeric else ", ".join(
        f"NULL::DOUBLE AS {n}" for n in ("mean", "std", "min", "max", "q25", "q50", "q75")
    )
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) AS rows, count(*) - count({column}) AS missing,
        count(DISTINCT {column}) AS distinct,
        (SELECT v FROM (SELECT CAST({column} AS VARCHAR) AS v, count(*) AS n FROM orders GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS top,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY {column})) AS top_rows, {described} FROM orders"""


@_add(
    "profile",
    " UNION ALL ".join(
        [_profiled("o_totalprice", "double", True), _profiled("o_custkey", "bigint", True),
         _profiled("o_orderstatus", "string", False), _profiled("o_orderpriority", "string", False)]
    ).replace("AS distinct", 'AS "distinct"'),
)
def profile(spark, d):
    out = stats.profile(s.read(spark, d, "orders"), ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"])
    return rounded(out, 4)


@_add(
    "sparsity",
    f"""SELECT z AS zeros, c AS cells, {q('z / c::DOUBLE', 9, 'sparsity')} FROM (SELECT CAST(count(*) FILTER (l_discount = 0)
    + count(*) FILTER (l_tax = 0) + count(*) FILTER (l_quantity = 0) AS BIGINT) AS z, count(*) * 3 AS c FROM lineitem)""",
)
def sparsity(spark, d):
    return rounded(stats.sparsity(s.read(spark, d, "lineitem"), ["l_discount", "l_tax", "l_quantity"]), 9)


def _pairs(columns, ordered):
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            if (ordered and True) or i < j:
                yield a, b


_WITH_MISSING = """SELECT l_quantity, CASE WHEN l_extendedprice < 60000 THEN l_extendedprice END AS l_extendedprice, l_discount, l_tax FROM lineitem"""


def _with_missing(spark, d):
    price = F.when(F.col("l_extendedprice") < 60000, F.col("l_extendedprice"))
    return s.read(spark, d, "lineitem").select("l_quantity", price.alias("l_extendedprice"), "l_discount", "l_tax")


@_add(
    "corr_matrix",
    sql(
        " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, {q(f'corr({a}, {b})', 8, 'corr')} FROM m" for a, b in _pairs(_NUMBERS, True)
        ),
        m=_WITH_MISSING,
    ).replace("WITH RECURSIVE", "WITH"),
)
def corr_matrix(spark, d):
    return rounded(stats.correlation_matrix(_with_missing(spark, d), _NUMBERS), 8)


_LINKED = """SELECT l_quantity AS a, l_quantity * 3 + l_linenumber AS b, l_quantity + l_discount * 300 AS c, l_tax AS e FROM lineitem"""
_NAMES = ["a", "b", "c", "e"]


def _linked(spark, d):
    return s.read(spark, d, "lineitem").select(
        F.col("l_quantity").alias("a"),
        (F.col("l_quantity") * 3 + F.col("l_linenumber")).alias("b"),
        (F.col("l_quantity") + F.col("l_discount") * 300).alias("c"),
        F.col("l_tax").alias("e"),
    )


@_add(
    "corr_pairs",
    sql(
        "SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT '{a}' AS a, '{b}' AS b, {q(f'corr({a}, {b})', 8, 'corr')} FROM linked" for a, b in _pairs(_NAMES, False)
        ) + ") WHERE corr > 0.8",
        linked=_LINKED,
    ),
)
def corr_pairs(spark, d):
    return rounded(stats.strong_pairs(_linked(spark, d), _NAMES, 0.8), 8)


# One pair (a, b) lies above the threshold, so one of the two goes.
@_add(
    "corr_prune",
    sql(
        """SELECT unnest(CASE WHEN abs(corr(a, c)) + abs(corr(a, e)) > abs(corr(b, c)) + abs(corr(b, e))
        THEN ['b', 'c', 'e'] ELSE ['a', 'c', 'e'] END) AS feature FROM linked""",
        linked=_LINKED,
    ),
)
def corr_prune(spark, d):
    kept = stats.prune_correlated(_linked(spark, d), _NAMES, 0.9)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@_add(
    "solution_corr",
    f"""SELECT {q('corr(o_totalprice, total)', 8, 'corr')} FROM orders
    JOIN (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def solution_corr(spark, d):
    other = s.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("total"))
    both = s.read(spark, d, "orders").select("o_orderkey", "o_totalprice").join(other, "o_orderkey")
    return rounded(both.agg(F.corr("o_totalprice", "total").alias("corr")), 8)


@_add(
    "percentiles",
    f"""SELECT {q('quantile_cont(value, 0.01)', 6, 'p1')}, {q('quantile_cont(value, 0.95)', 6, 'p95')},
    {q('quantile_cont(value, 0.99)', 6, 'p99')} FROM events""",
)
def percentiles(spark, d):
    return rounded(stats.percentile_row(s.read(spark, d, "events"), "value", (0.01, 0.95, 0.99), ("p1", "p95", "p99")))


@_add(
    "percentile_clip",
    f"""SELECT event_id, {q('(greatest(least(value, hi), lo) - lo) / (hi - lo + 1e-9)', 6, 'scaled')} FROM events,
    (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events)""",
)
def percentile_clip(spark, d):
    return rounded(stats.rescaled(s.read(spark, d, "events").select("event_id", "value"), "value", "scaled").drop("value"))


@_add(
    "swarm_layout",
    f"""SELECT event_id, CAST(bin AS BIGINT) AS bin, {q("(k // 2 + 1) * 0.12::DOUBLE * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END", 6, 'y')}
    FROM (SELECT event_id, floor(value / 0.05::DOUBLE) AS bin,
          row_number() OVER (PARTITION BY floor(value / 0.05::DOUBLE) ORDER BY value, event_id) - 1 AS k FROM events)""",
)
def swarm_layout(spark, d):
    out = stats.swarm_layout(s.read(spark, d, "events").select("event_id", "value"), "value", "event_id")
    return rounded(out.drop("value"))


@_add(
    "mean_abs_ranking",
    f"""SELECT "column", {q('importance', 6)} FROM (SELECT 'value' AS "column", avg(abs(value)) AS importance FROM events
    UNION ALL SELECT 'centred', avg(abs(value - 50)) FROM events
    UNION ALL SELECT 'user_id', avg(abs(user_id)) FROM events) ORDER BY 2 DESC LIMIT 2""",
)
def mean_abs_ranking(spark, d):
    wide = s.read(spark, d, "events").select("value", (F.col("value") - 50).alias("centred"), "user_id")
    return rounded(stats.mean_abs_ranking(wide, ["value", "centred", "user_id"], 2))


@_add("global_max", "SELECT max(l_extendedprice) AS top, count(*) AS rows, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def global_max(spark, d):
    return s.read(spark, d, "lineitem").agg(
        F.max("l_extendedprice").alias("top"), F.count(F.lit(1)).alias("rows"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@_add(
    "conditional_sums",
    """SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, max(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS any_large,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open FROM lineitem GROUP BY 1""",
)
def conditional_sums(spark, d):
    return s.read(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.max(F.when(F.col("l_quantity") > 49, 1).otherwise(0)).alias("any_large"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("open"),
    )


@_add(
    "densest_track",
    """SELECT l_orderkey, count(*) AS points FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
)
def densest_track(spark, d):
    counts = s.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("points"))
    return counts.orderBy(F.desc("points"), "l_orderkey").limit(1)


@_add("top_prices", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def top_prices(spark, d):
    return s.read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


_PREDICTIONS = """SELECT o_orderkey AS flightid, CAST(o_orderkey % 5 AS INT) AS fold, o_totalprice AS target,
    o_totalprice * 0.9 + o_custkey AS prediction FROM orders"""


def _predictions(spark, d):
    return s.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("flightid"),
        (F.col("o_orderkey") % 5).cast("int").alias("fold"),
        F.col("o_totalprice").alias("target"),
        (F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("prediction"),
    )


@_add(
    "fold_rmse",
    f"""SELECT {q('avg(rmse)', 4, 'mean_rmse')}, count(*) AS folds
    FROM (SELECT fold, sqrt(avg(pow(target - prediction, 2))) AS rmse FROM ({_PREDICTIONS}) GROUP BY fold)""",
)
def fold_rmse(spark, d):
    return rounded(stats.mean_fold_rmse(_predictions(spark, d)), 4)


@_add(
    "fold_mean",
    f"""SELECT l_orderkey AS flightid, {q('avg(l_extendedprice)', 4, 'solution')} FROM lineitem GROUP BY 1""",
)
def fold_mean(spark, d):
    rows = s.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("flightid"), F.col("l_extendedprice").alias("prediction"))
    return rounded(models.ensemble(rows, "flightid"), 4)


@_add(
    "linear_contrib_topk",
    f"""SELECT "column", {q('importance', 4)} FROM (
    SELECT 'l_quantity' AS "column", avg(abs(2.5 * (l_quantity - mq))) AS importance FROM lineitem, (SELECT avg(l_quantity) AS mq FROM lineitem)
    UNION ALL SELECT 'l_discount', avg(abs(-100.0 * (l_discount - md))) FROM lineitem, (SELECT avg(l_discount) AS md FROM lineitem)
    UNION ALL SELECT 'l_tax', avg(abs(7.0 * (l_tax - mt))) FROM lineitem, (SELECT avg(l_tax) AS mt FROM lineitem)) ORDER BY importance DESC LIMIT 2""",
)
def linear_contrib_topk(spark, d):
    lines = s.read(spark, d, "lineitem")
    weights = {"l_quantity": 2.5, "l_discount": -100.0, "l_tax": 7.0}
    means = {c: m for c, (m, _) in encode.scaling(lines, list(weights)).items()}
    parts = explain.linear_contributions(lines, weights, means)
    return rounded(explain.top_contributions(parts, list(weights), 2), 4)
