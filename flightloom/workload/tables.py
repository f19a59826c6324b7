"""Queries on plain columns: filters, text, times, unions and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text, times
from ..operators import clean, joins, validate
from ..sources.schemas import FEATURES
from . import standins as s
from .registry import Registry
from .standins import q, r, sql
from .tracks import movements

REGISTRY = Registry()
_add = REGISTRY.add

_IMAGE = "'http://img/' || event_id || '/S' || user_id || '_' || strftime(ts, '%Y%m%d%H%M') || '.jpg'"


def _image_paths(spark, d):
    stamp = F.date_format("ts", "yyyyMMddHHmm")
    path = F.concat(F.lit("http://img/"), "event_id", F.lit("/S"), "user_id", F.lit("_"), stamp, F.lit(".jpg"))
    return s.read(spark, d, "events").select("event_id", path.alias("path"))


@_add(
    "path_time",
    f"""SELECT event_id, string_split({_IMAGE}, '/')[-1] AS name, strftime(ts, '%Y%m%d%H%M') AS stamp,
    strftime(ts, '%Y-%m-%d %H:%M:00') AS at FROM events""",
)
def path_time(spark, d):
    at = F.date_format(text.image_time(F.col("path")), "yyyy-MM-dd HH:mm:ss")
    return _image_paths(spark, d).select(
        "event_id", text.file_name(F.col("path")).alias("name"), text.image_stamp(F.col("path")).alias("stamp"), at.alias("at")
    )


@_add("page_file_name", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def page_file_name(spark, d):
    return s.read(spark, d, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@_add(
    "distinct_paths",
    f"""SELECT count(*) AS paths, count(DISTINCT {_IMAGE}) AS distinct_paths,
    count(DISTINCT string_split({_IMAGE}, '/')[-1]) AS distinct_names FROM events""",
)
def distinct_paths(spark, d):
    return _image_paths(spark, d).agg(
        F.count("path").alias("paths"),
        F.count_distinct("path").alias("distinct_paths"),
        F.count_distinct(text.file_name(F.col("path"))).alias("distinct_names"),
    )


@_add("route_suffix", sql("SELECT flightid, substr(origem, 3) AS short, origem || destino AS linha FROM movements", "movements"))
def route_suffix(spark, d):
    return s.movements(spark, d).select(
        "flightid",
        text.drop_prefix(F.col("origem"), 2).alias("short"),
        text.route_key(F.col("origem"), F.col("destino")).alias("linha"),
    )


@_add(
    "normalize_space",
    r"""SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS tidy,
    length(replace(text, 'the', 'THEN')) AS swapped FROM documents""",
)
def normalize_space(spark, d):
    return s.read(spark, d, "documents").select(
        "doc_id",
        F.md5(text.squeeze_spaces(F.col("text"))).alias("tidy"),
        F.length(text.swap_word(F.col("text"), "the", "THEN")).alias("swapped"),
    )


@_add(
    "label_parts",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H') AS hour, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at,
    CAST(user_id AS INT) AS poly FROM events""",
)
def label_parts(spark, d):
    label = F.concat(
        F.lit("('"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(".jpg', "), F.col("user_id").cast("string"), F.lit(")")
    )
    return s.read(spark, d, "events").select("event_id", label.alias("label")).select(
        "event_id",
        text.label_hour(F.col("label")).alias("hour"),
        F.date_format(text.label_time(F.col("label")), "yyyy-MM-dd HH:mm:ss").alias("at"),
        text.label_polygon(F.col("label")).alias("poly"),
    )


@_add(
    "unwrap_and_join",
    """SELECT c_custkey, c_mktsegment AS plain, c_mktsegment || ', ' || c_name AS listed FROM customer""",
)
def unwrap_and_join(spark, d):
    wrapped = F.concat(F.lit("['"), F.col("c_mktsegment"), F.lit("']"))
    return s.read(spark, d, "customer").select(
        "c_custkey",
        text.unwrap(wrapped).alias("plain"),
        text.join_list(F.array("c_mktsegment", "c_name")).alias("listed"),
    )


@_add(
    "time_parts",
    """SELECT event_id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%d %H') AS hour_text, CAST(hour(ts) AS INT) AS hora,
    CAST(isodow(ts) - 1 AS INT) AS dia, strftime(ts, '%Y-%m-%d') AS data,
    strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS later,
    strftime(make_timestamp(epoch_us(ts) + 90000000), '%Y-%m-%d %H:%M:%S') AS shifted,
    CAST(floor((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 1000000.0) AS BIGINT) AS whole,
    round((epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) / 1000000.0, 6) AS exact FROM events""",
)
def time_parts(spark, d):
    events = s.read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    at, middle = F.col("at"), F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    return events.select(
        "event_id",
        times.to_epoch_ms(at).alias("ms"),
        times.hour_text(at).alias("hour_text"),
        times.hour_of_day(at).alias("hora"),
        times.weekday(at).alias("dia"),
        times.calendar_date(at).cast("string").alias("data"),
        F.date_format(times.add_hours(at, 1), "yyyy-MM-dd HH:mm").alias("later"),
        F.date_format(times.shift_micros(at, F.lit(90_000_000)), "yyyy-MM-dd HH:mm:ss").alias("shifted"),
        times.whole_seconds(at, middle).alias("whole"),
        F.round(times.exact_seconds(at, middle), 6).alias("exact"),
    )


@_add(
    "text_to_time",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2024-02-03 00:00:00' WHEN doc_id % 3 = 1 THEN NULL ELSE NULL END AS at,
    CASE WHEN doc_id % 3 = 2 THEN NULL ELSE '2024-02-03' END AS day FROM documents""",
)
def text_to_time(spark, d):
    raw = F.when(F.col("doc_id") % 3 == 0, "2024-02-03 00:00:00").when(F.col("doc_id") % 3 == 1, "2024-02-03").otherwise(F.col("lang"))
    return s.read(spark, d, "documents").select(
        "doc_id",
        F.date_format(times.parse_timestamp(raw), "yyyy-MM-dd HH:mm:ss").alias("at"),
        times.parse_date(raw).cast("string").alias("day"),
    )


@_add("filter_sentinel", "SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS k FROM orders) WHERE k IS DISTINCT FROM 'P'")
def filter_sentinel(spark, d):
    rows = s.read(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("k"))
    return clean.keep_except(rows, "k", "P")


@_add(
    "filter_targets",
    sql("SELECT flightid, target FROM flights WHERE target > 1500 AND origem <> destino", "flights"),
)
def filter_targets(spark, d):
    kept = movements(spark, d).where((F.col("target") > 1500) & (F.col("origem") != F.col("destino")))
    return kept.select("flightid", "target")


@_add(
    "filter_time_window",
    """SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-05 10:00:00' AND ts < TIMESTAMP '2024-01-06 10:00:00'""",
)
def filter_time_window(spark, d):
    events = s.read(spark, d, "events")
    return clean.between_times(events, "ts", "2024-01-05 10:00:00", "2024-01-06 10:00:00").select("event_id", "value")


@_add(
    "filter_dates",
    """SELECT event_id, CAST(ts > TIMESTAMP '2024-01-21 00:00:00' AS INT) AS late FROM events
    WHERE ts::DATE = DATE '2024-01-07' OR ts > TIMESTAMP '2024-01-21 00:00:00'""",
)
def filter_dates(spark, d):
    late = F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-21 00:00:00"))
    return s.read(spark, d, "events").where((F.to_date("ts") == F.lit("2024-01-07").cast("date")) | late).select(
        "event_id", numbers.flag(late).alias("late")
    )


@_add(
    "filter_box",
    sql("SELECT flightid, dt_radar, lat, lon FROM points WHERE lat BETWEEN -30 AND 10 AND lon BETWEEN -75 AND -30", "points"),
)
def filter_box(spark, d):
    from ..functions.geo import in_box

    box = in_box(F.col("lat"), F.col("lon"), -30, 10, -75, -30)
    return s.points_degrees(spark, d).where(box).select("flightid", "dt_radar", "lat", "lon")


@_add(
    "fill_missing",
    """SELECT event_id, coalesce(v, -99) AS v, CASE WHEN v IS NULL THEN 1 ELSE 0 END AS v_missing, coalesce(w, 0) AS w
    FROM (SELECT event_id, CASE WHEN value > 60 THEN NULL ELSE value END AS v, CASE WHEN value < 5 THEN NULL ELSE value END AS w FROM events)""",
)
def fill_missing(spark, d):
    rows = s.read(spark, d, "events").select(
        "event_id",
        F.when(F.col("value") <= 60, F.col("value")).alias("v"),
        F.when(F.col("value") >= 5, F.col("value")).alias("w"),
    )
    return clean.fill_numbers(clean.with_missing_flags(rows, ["v"]), 0, ["w"])


@_add(
    "keep_known",
    "SELECT event_id, value AS v FROM events WHERE value <= 60 AND value >= 5",
)
def keep_known(spark, d):
    rows = s.read(spark, d, "events").select("event_id", F.when(F.col("value").between(5, 60), F.col("value")).alias("v"))
    return clean.keep_known(rows, ["v"])


@_add(
    "cast_text",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(TRY_CAST(event_type AS INT) IS NULL AS INT) AS bad,
    CAST(user_id AS VARCHAR) AS who FROM events""",
)
def cast_text(spark, d):
    return s.read(spark, d, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
        numbers.flag(F.col("event_type").try_cast("int").isNull()).alias("bad"),
        F.col("user_id").cast("string").alias("who"),
    )


@_add(
    "flags_and_scale",
    sql(
        f"""SELECT flightid, {q('target / 446.0', 6, 'scaled')}, CASE WHEN origem = destino THEN 1 ELSE 0 END AS same,
        CASE WHEN origem = destino THEN 0.0::DOUBLE ELSE CAST(target AS DOUBLE) END AS solution, 1 AS one FROM flights""",
        "flights",
    ),
)
def flags_and_scale(spark, d):
    same = F.col("origem") == F.col("destino")
    return movements(spark, d).select(
        "flightid",
        r(F.col("target") / F.lit(446.0)).alias("scaled"),
        numbers.flag(same).alias("same"),
        numbers.override(same, 0.0, F.col("target").cast("double")).alias("solution"),
        F.lit(1).alias("one"),
    )


@_add(
    "union_batches",
    """SELECT o_orderkey AS id, o_orderstatus AS kind, o_totalprice AS price FROM orders
    UNION ALL SELECT l_orderkey, l_linestatus, NULL FROM lineitem""",
)
def union_batches(spark, d):
    orders = s.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_totalprice").alias("price")
    )
    lines = s.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("kind"))
    return clean.append(orders, lines)


@_add(
    "clean_names",
    f"""SELECT n_regionkey, {q('avg(n_nationkey)', 6, '"keymean"')}, count(*) AS "rows1" FROM nation GROUP BY 1""",
)
def clean_names(spark, d):
    nation = s.read(spark, d, "nation")
    wide = nation.groupBy("n_regionkey").agg(F.avg("n_nationkey").alias("<key>.mean"), F.count(F.lit(1)).alias("['rows'],1"))
    out = text.clean_names(wide)
    return out.withColumn("keymean", r("keymean"))


@_add(
    "renamed_columns",
    """SELECT c_nationkey AS pais, count(*) AS n, round(avg(c_acctbal) + 1e-9, 6) + 0.0::DOUBLE AS c_acctbal_mean,
    min(c_acctbal) AS c_acctbal_min, max(c_acctbal) AS c_acctbal_max FROM customer GROUP BY 1""",
)
def renamed_columns(spark, d):
    stats = clean.several(["c_acctbal"], {"mean": F.avg, "min": F.min, "max": F.max})
    wide = s.read(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("rows"), *stats)
    out = clean.rename(wide, {"c_nationkey": "pais", "rows": "n"})
    return out.withColumn("c_acctbal_mean", r("c_acctbal_mean"))


@_add("distinct_values", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part")
def distinct_values(spark, d):
    return clean.rename_by_place(s.read(spark, d, "part").select("p_brand", "p_type").distinct(), ["brand", "type"])


_MADE = ["flightid", "origem", "destino", "linha", "target", "diaSemana", "hora"]


def _contract_row(name: str) -> str:
    shown = name.replace("'", "''")
    if name not in _MADE:
        return f"SELECT '{shown}' AS \"column\", 'missing' AS problem, 0::BIGINT AS rows, 0::BIGINT AS nulls"
    problem = "'extra'" if name not in FEATURES else "'type'" if name == "hora" else "'ok'"
    return f"SELECT '{shown}', {problem}, count(*), count(*) - count({name}) FROM made"


@_add(
    "contract_diff",
    sql(
        " UNION ALL ".join(_contract_row(c) for c in sorted({*FEATURES, *_MADE}, key=lambda c: c in _MADE)),
        "flights", made="SELECT flightid, nullif(origem, 'SBAK') AS origem, destino, linha, target, diaSemana, hora::VARCHAR AS hora FROM flights",
    ),
)
def contract_diff(spark, d):
    made = movements(spark, d).select(*_MADE).withColumns({"hora": F.col("hora").cast("string"), "origem": F.nullif("origem", F.lit("SBAK"))})
    return validate.contract_report(made, FEATURES, ["hora", "diaSemana"])


@_add(
    "join_fanout_check",
    "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def join_fanout_check(spark, d):
    return validate.repeated_keys(s.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@_add(
    "agreement_flag",
    sql("SELECT CASE WHEN origem = destino THEN 1 ELSE 0 END AS eqq, count(*) AS rows FROM movements GROUP BY 1", "movements"),
)
def agreement_flag(spark, d):
    return validate.agreement(s.movements(spark, d), "origem", "destino")


@_add(
    "member_orders",
    """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def member_orders(spark, d):
    finished = s.read(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("l_orderkey"))
    lines = s.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return joins.keep_members(lines, finished, ["l_orderkey"])


@_add(
    "inner_join_customers",
    """SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0""",
)
def inner_join_customers(spark, d):
    customer = s.read(spark, d, "customer").where(F.col("c_acctbal") > 0).select("c_custkey", "c_name", "c_mktsegment")
    orders = s.read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@_add(
    "sql_view",
    sql("SELECT linha, count(*) AS flights, max(target) AS longest FROM flights GROUP BY linha", "flights"),
)
def sql_view(spark, d):
    from ..sources.sinks import as_view

    as_view(movements(spark, d), "flightloom_flights")
    return spark.sql("SELECT linha, count(*) AS flights, max(target) AS longest FROM flightloom_flights GROUP BY linha")


@_add(
    "in_contract_order",
    sql("SELECT linha, target, flightid FROM flights", "flights"),
)
def in_contract_order(spark, d):
    return clean.in_order(movements(spark, d), ["linha", "target", "flightid"])
