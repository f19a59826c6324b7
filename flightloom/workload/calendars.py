"""Queries on hourly airport tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars, joins
from ..sources import readers
from . import standins as s
from .registry import Registry
from .standins import q, r, rounded, sql
from .tracks import movements

REGISTRY = Registry()
_add = REGISTRY.add


def holdings(spark, d):
    return calendars.with_calendar(s.holdings(spark, d))


def _profile_sql(column: str, airport: str) -> str:
    measures = f"{q(f'avg({column})', 6, 'mean')}, {q(f'sum({column})', 4, 'sum')}"
    return " UNION ALL ".join(
        [
            f"SELECT 'hour' AS level, {airport} AS aero, hora, -1 AS diaSemana, {measures} FROM holdings GROUP BY {airport}, hora",
            f"SELECT 'weekday', {airport}, -1, diaSemana, {measures} FROM holdings GROUP BY {airport}, diaSemana",
            f"SELECT 'airport', {airport}, -1, -1, {measures} FROM holdings GROUP BY {airport}",
        ]
    )


def _shown(df):
    return df.withColumns({"mean": r("mean", 6), "sum": r("sum", 4)}).fillna(-1, subset=["hora", "diaSemana"])


@_add("hourly_profile_by_key", sql(_profile_sql("esperas", "aero"), "holdings"))
def hourly_profile_by_key(spark, d):
    return _shown(calendars.profile_sets(holdings(spark, d), calendars.mean_and_sum("esperas")))


@_add("predicted_change_profile", sql(_profile_sql("troca", "short"), "holdings"))
def predicted_change_profile(spark, d):
    rows = calendars.with_calendar(s.predicted_changes(spark, d))
    return _shown(calendars.profile_sets(rows, calendars.mean_and_sum("troca")))


@_add(
    "actual_change_profile",
    sql(
        """SELECT 'hour' AS level, short AS aero, hora, -1 AS diaSemana, count(short) AS troca_real FROM holdings GROUP BY short, hora
        UNION ALL SELECT 'weekday', short, -1, diaSemana, count(short) FROM holdings GROUP BY short, diaSemana
        UNION ALL SELECT 'airport', short, -1, -1, count(short) FROM holdings GROUP BY short""",
        "holdings",
    ),
)
def actual_change_profile(spark, d):
    tables = calendars.profiles(calendars.with_calendar(s.actual_changes(spark, d)), calendars.count_of("aero"))
    parts = [t.withColumn("level", F.lit(n)) for n, t in tables.items()]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(
        parts[2], allowMissingColumns=True
    ).fillna(-1, subset=["hora", "diaSemana"])


# The checks join flights to every row of their hour and sum afterwards.
@_add(
    "bucket_exposure_sum",
    sql(
        f"""SELECT f.flightid, {q('coalesce(sum(h.esperas), 0)', 4, 'esperas')}
        FROM flights f LEFT JOIN holdings h ON f.dep_hour = h.hour_ts GROUP BY f.flightid""",
        "flights", "holdings",
    ),
)
def bucket_exposure_sum(spark, d):
    out = calendars.bucket_sum(movements(spark, d), holdings(spark, d), "esperas", "esperas")
    return out.select("flightid", r("esperas", 4).alias("esperas"))


@_add(
    "bucket_sum_at_airport",
    sql(
        f"""SELECT f.flightid, {q('coalesce(sum(h.esperas), 0)', 4, 'esperas')} FROM flights f
        LEFT JOIN holdings h ON f.dep_hour = h.hour_ts AND f.origem = h.aero GROUP BY f.flightid""",
        "flights", "holdings",
    ),
)
def bucket_sum_at_airport(spark, d):
    keys = dict(flight_keys=["dep_hour", "origem"], row_keys=["hour_ts", "aero"])
    out = calendars.bucket_sum(movements(spark, d), holdings(spark, d), "esperas", "esperas", **keys)
    return out.select("flightid", r("esperas", 4).alias("esperas"))


@_add(
    "bucket_count_min1",
    sql(
        """SELECT f.flightid, count(h.hora_ms) AS matches, count(*) AS trocareal FROM flights f
        LEFT JOIN holdings h ON f.dep_hour = h.hour_ts AND f.origem = h.aero GROUP BY f.flightid""",
        "flights", "holdings",
    ),
)
def bucket_count_min1(spark, d):
    rows = holdings(spark, d)
    keys = dict(flight_keys=["dep_hour", "origem"], row_keys=["hour_ts", "aero"])
    out = calendars.bucket_count(movements(spark, d), rows, "matches", **keys)
    out = calendars.bucket_count(out, rows, "trocareal", at_least=1, **keys)
    return out.select("flightid", "matches", "trocareal")


_NAMES = ("mean_x", "sum_x", "mean_y", "sum_y", "mean", "sum")


@_add(
    "calendar_features",
    sql(
        f"""SELECT f.flightid, {', '.join(q(n, 4) for n in _NAMES)} FROM flights f
        LEFT JOIN (SELECT aero, hora, avg(esperas) AS mean_x, sum(esperas) AS sum_x FROM holdings GROUP BY ALL) a
          ON a.aero = f.origem AND a.hora = f.hora
        LEFT JOIN (SELECT aero, diaSemana, avg(esperas) AS mean_y, sum(esperas) AS sum_y FROM holdings GROUP BY ALL) b
          ON b.aero = f.origem AND b.diaSemana = f.diaSemana
        LEFT JOIN (SELECT aero, avg(esperas) AS mean, sum(esperas) AS sum FROM holdings GROUP BY ALL) c ON c.aero = f.origem""",
        "flights", "holdings",
    ),
)
def calendar_features(spark, d):
    from ..plans.features import HOLDING_NAMES

    tables = calendars.profiles(holdings(spark, d), calendars.mean_and_sum("esperas"))
    out = calendars.attach_profiles(movements(spark, d), tables, "origem", HOLDING_NAMES)
    return out.select("flightid", *[r(n, 4).alias(n) for n in _NAMES])


@_add(
    "suffix_join",
    sql(
        f"""SELECT a.aero, a.hora, {q('a.m', 6, 'mean_x')}, {q('b.m', 6, 'mean_y')}
        FROM (SELECT aero, hora, avg(esperas) AS m FROM holdings GROUP BY ALL) a
        JOIN (SELECT aero, hora, avg(troca) AS m FROM holdings GROUP BY ALL) b ON a.aero = b.aero AND a.hora = b.hora""",
        "holdings",
    ),
)
def suffix_join(spark, d):
    rows = calendars.with_calendar(
        s.holdings(spark, d).withColumn("troca", F.when(F.col("esperas") > 50, 1.0).otherwise(0.0))
    )
    a = calendars.profile_by(rows, ["aero", "hora"], {"mean": F.avg("esperas")})
    b = calendars.profile_by(rows, ["aero", "hora"], {"mean": F.avg("troca")})
    return rounded(joins.both_suffixes(a, b, ["aero", "hora"], "inner"))


@_add(
    "null_safe_join",
    sql(
        f"""SELECT f.flightid, {q('t.total', 4, 'total')}
        FROM (SELECT flightid, nullif(origem, 'SBAK') AS k FROM flights) f
        LEFT JOIN (SELECT nullif(aero, 'SBAK') AS k, sum(esperas) AS total FROM holdings GROUP BY 1) t
          ON f.k IS NOT DISTINCT FROM t.k""",
        "flights", "holdings",
    ),
)
def null_safe_join(spark, d):
    flights = movements(spark, d).select("flightid", F.nullif("origem", F.lit("SBAK")).alias("k"))
    sums = holdings(spark, d).groupBy(F.nullif("aero", F.lit("SBAK")).alias("k")).agg(F.sum("esperas").alias("total"))
    out = joins.attach(flights, sums, ["k"], null_safe=True)
    return out.select("flightid", r("total", 4).alias("total"))


@_add(
    "calendar_spine",
    """SELECT strftime(i, '%Y-%m-%d') AS idate, strftime(i + INTERVAL 1 DAY, '%Y-%m-%d') AS fdate, coalesce(n, 0) AS rows
    FROM (SELECT unnest(generate_series((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS i)
    LEFT JOIN (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1) ON day = i::DATE""",
)
def calendar_spine(spark, d):
    events = s.read(spark, d, "events").withColumn("idate", F.to_date("ts"))
    first, last = events.agg(F.min("idate").cast("string"), F.max("idate").cast("string")).first()
    days = readers.day_windows(spark, first, last)
    counts = events.groupBy("idate").agg(F.count(F.lit(1)).alias("rows"))
    return joins.attach(days, counts, ["idate"]).select(
        F.col("idate").cast("string").alias("idate"), F.col("fdate").cast("string").alias("fdate"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


@_add(
    "day_gaps",
    """SELECT strftime(i, '%Y-%m-%d') AS idate FROM (SELECT unnest(generate_series((SELECT min(o_orderdate) FROM orders)::DATE::TIMESTAMP,
    (SELECT max(o_orderdate) FROM orders)::DATE::TIMESTAMP, INTERVAL 1 DAY)) AS i)
    WHERE i::DATE NOT IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def day_gaps(spark, d):
    from ..operators.validate import day_gaps as gaps

    orders = s.read(spark, d, "orders")
    first, last = orders.agg(
        F.min(F.to_date("o_orderdate")).cast("string"), F.max(F.to_date("o_orderdate")).cast("string")
    ).first()
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    return gaps(urgent, "o_orderdate", readers.day_windows(spark, first, last)).select(
        F.col("idate").cast("string").alias("idate")
    )
