"""The balanced forms give the same rows as the plain ones, also when a key is hot."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightloom.operators import positions, skew

from .conftest import rows


@pytest.fixture(scope="module")
def left(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(20)}", i, rng.random()) for i in range(600)]
    return spark.createDataFrame(data, "k string, i int, v double")


@pytest.fixture(scope="module")
def right(spark):
    return spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "k string, w int")


def test_hot_keys(left):
    found = skew.hot_keys(left, ["k"], 50)
    assert {r["k"] for r in found.collect()} == {"hot", None}
    assert skew.hot_keys(left, ["k"], 10_000) is None


def test_any_number_of_hot_keys(spark):
    many = spark.range(9000).selectExpr("id % 3000 AS k", "id AS i")
    assert skew.hot_keys(many, ["k"], 2).count() == 3000
    got = positions.position_in_group(many, ["k"], ["i"], "p", 2)
    assert got.where("p = i div 3000").count() == 9000
    side = spark.range(3000).selectExpr("id AS k", "id * 2 AS w")
    assert skew.skew_join(many, side, ["k"], rows_per_task=2).where("w = 2 * k").count() == 9000


def test_join_without_limit_counts_nothing(left, right):
    plan = skew.skew_join(left, right, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" not in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_skew_join_equals_join(left, right, how):
    side = right.select("k").distinct() if how == "left_semi" else right
    plain = left.join(side, ["k"], how)
    dealt = skew.skew_join(left, side, ["k"], how, rows_per_task=10)
    assert rows(dealt, *plain.columns) == rows(plain)


def test_hot_rows_are_spread(left, right):
    dealt = skew.skew_join(left, right, ["k"], "inner", rows_per_task=10)
    assert "_slice" in dealt._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("limit", [5, 10_000])
def test_positions(left, limit):
    got = positions.position_in_group(left, ["k"], ["v", "i"], "p", limit)
    expected = {}
    for key, group in left.toPandas().groupby("k", dropna=False):
        for p, i in enumerate(group.sort_values(["v", "i"])["i"]):
            expected[i] = p
    assert {r["i"]: r["p"] for r in got.collect()} == expected


def test_global_positions_descending(left):
    got = positions.position_in_group(left, [], [F.desc("v"), "i"], "p")
    order = left.toPandas().sort_values(["v", "i"], ascending=[False, True])["i"].tolist()
    assert [r["i"] for r in got.orderBy("p").collect()] == order


def test_running_total(spark):
    data = [("a", float(i), i + 1) for i in range(50)] + [("b", float(i), 2) for i in range(9)]
    df = spark.createDataFrame(data, "g string, o double, w long")
    got = positions.running_total(df, ["g"], ["o"], "w", "before")
    sums = {(r["g"], r["o"]): r["before"] for r in got.collect()}
    assert sums[("a", 0.0)] == 0 and sums[("a", 10.0)] == sum(range(1, 11)) and sums[("b", 8.0)] == 16


@pytest.mark.parametrize("parts", ["1", "8"])
def test_percentiles_equal_numpy(spark, parts):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 501).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        probabilities = (0.0, 0.01, 0.25, 0.5, 0.95, 1.0)
        counts = positions.value_counts(positions.long_form(df, ["x"]))
        got = {r["probability"]: r["percentile"] for r in positions.exact_percentiles(counts, probabilities).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [got[p] for p in probabilities] == pytest.approx([np.quantile(x, p) for p in probabilities])


def test_collapse_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "i int, t string")
    assert rows(skew.collapse_copies(df)) == sorted([(1, "a", 2), (2, None, 2), (3, "c", 1)], key=repr)
