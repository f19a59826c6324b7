"""Queries on codes, dummies, scaling and hash-based selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import stable_bucket
from ..ml import prepare
from ..operators import encode, stats
from . import standins as s
from .registry import Registry
from .standins import q, r, rounded, sql

REGISTRY = Registry()
_add = REGISTRY.add

_CODES = """SELECT value, CAST(row_number() OVER (ORDER BY first, value) - 1 AS INT) AS code
    FROM (SELECT c_mktsegment AS value, min(c_custkey) AS first FROM customer GROUP BY 1)"""


def _dictionary(spark, d):
    return encode.label_dictionary(s.read(spark, d, "customer"), "c_mktsegment", "c_custkey")


@_add("label_codes", _CODES)
def label_codes(spark, d):
    return _dictionary(spark, d)


@_add("route_codes", sql(
    """SELECT value, CAST(row_number() OVER (ORDER BY first, value) - 1 AS INT) AS code
    FROM (SELECT origem || destino AS value, min(flightid) AS first FROM movements GROUP BY 1)""", "movements"))
def route_codes(spark, d):
    flights = s.movements(spark, d).withColumn("linha", F.concat("origem", "destino"))
    return encode.label_dictionary(flights, "linha", "flightid")


@_add(
    "encode_values",
    f"""SELECT c_custkey, coalesce(code, -1) AS segment FROM (SELECT c_custkey, nullif(c_mktsegment, 'MACHINERY') AS v FROM customer)
    LEFT JOIN ({_CODES}) ON v = value""",
)
def encode_values(spark, d):
    rows = s.read(spark, d, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"))
    return encode.encode(rows, "segment", _dictionary(spark, d))


@_add(
    "decode_codes",
    f"""SELECT c_custkey, value AS segment FROM (SELECT c_custkey, c_custkey % 7 AS k FROM customer) LEFT JOIN ({_CODES}) ON k = code""",
)
def decode_codes(spark, d):
    rows = s.read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("segment"))
    return encode.decode(rows, "segment", _dictionary(spark, d))


@_add(
    "look_up_names",
    "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def look_up_names(spark, d):
    from ..operators.joins import look_up

    rows = s.read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return look_up(rows, "nation", s.read(spark, d, "nation"), "n_nationkey", "n_name")


@_add(
    "onehot_low_card",
    """SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS o_orderstatus_F, CAST(o_orderstatus = 'O' AS INT) AS o_orderstatus_O,
    CAST(o_orderstatus = 'P' AS INT) AS o_orderstatus_P FROM orders""",
)
def onehot_low_card(spark, d):
    orders = s.read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return encode.one_hot(orders, encode.low_cardinality(orders, ["o_orderkey", "o_orderstatus"]))


@_add(
    "low_card_cols",
    """SELECT count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_linestatus) AS l_linestatus,
    count(DISTINCT l_linenumber) AS l_linenumber, count(DISTINCT l_quantity) AS l_quantity FROM lineitem""",
)
def low_card_cols(spark, d):
    columns = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
    return encode.distinct_counts(s.read(spark, d, "lineitem"), columns)


@_add(
    "zscore_scale",
    f"""SELECT o_orderkey, {q('(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders)', 6, 'o_totalprice')},
    0.0::DOUBLE AS same FROM orders""",
)
def zscore_scale(spark, d):
    orders = s.read(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(3.0).alias("same"))
    fitted = encode.scaling(orders, ["o_totalprice", "same"])
    return rounded(encode.standardise(orders, fitted))


def _bucket(key: str, buckets: int) -> str:
    return f"CAST(CAST('0x' || substr(md5({key} || '-42'), 1, 8) AS BIGINT) % {buckets} AS INT)"


@_add("hash_folds", f"SELECT o_orderkey, {_bucket('o_orderkey', 10)} AS fold, CAST({_bucket('o_orderkey', 100)} < 80 AS INT) AS is_train FROM orders")
def hash_folds(spark, d):
    out = prepare.with_split(prepare.with_fold(s.read(spark, d, "orders").select("o_orderkey"), "o_orderkey"), "o_orderkey")
    return out.withColumn("is_train", F.col("is_train").cast("int"))


@_add("pixel_jitter", f"SELECT event_id, {q(_bucket('event_id', 1000000) + ' / 1000000.0 * 0.7 - 0.35', 6, 'jitter')} FROM events")
def pixel_jitter(spark, d):
    return s.read(spark, d, "events").select("event_id", r(numbers.jitter(F.col("event_id"), 42)).alias("jitter"))


@_add(
    "seeded_sample",
    "SELECT l_orderkey, l_linenumber FROM (SELECT * FROM lineitem ORDER BY md5(l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_extendedprice::DECIMAL(12,2) || '-42') LIMIT 8000)",
)
def seeded_sample(spark, d):
    key = F.concat_ws(
        ":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    )
    rows = s.read(spark, d, "lineitem").withColumn("key", key).select("l_orderkey", "l_linenumber", "key")
    return stats.seeded_sample(rows, "key", 8000).drop("key")


@_add("bucket_sizes", f"SELECT {_bucket('o_orderkey', 5)} AS fold, count(*) AS rows FROM orders GROUP BY 1")
def bucket_sizes(spark, d):
    fold = stable_bucket(F.col("o_orderkey"), 42, 5).alias("fold")
    return s.read(spark, d, "orders").groupBy(fold).agg(F.count(F.lit(1)).alias("rows"))
