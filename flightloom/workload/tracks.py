"""Queries on tracks and flights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, flights as flight_ops, positions, skew, tracks
from ..plans import synthetic
from . import standins as s
from .registry import Registry
from .standins import q, r, rounded, sql

REGISTRY = Registry()
_add = REGISTRY.add


_EXACT = ("flightid", "n_points", "flightlevel_min", "flightlevel_max", "speed_min", "speed_max")
_SHOWN = (
    "duration", "lat_first", "lat_last", "lon_first", "lon_last", "flightlevel_mean", "flightlevel_std",
    "speed_mean", "speed_std", "distancia",
)


def summary(spark, d):
    return tracks.track_summary(tracks.degrees_of(s.points(spark, d)))


def gappy_summary(spark, d):
    return tracks.track_summary(tracks.degrees_of(s.gappy_points(spark, d)))


def movements(spark, d):
    return flight_ops.prepare_flights(s.movements(spark, d))


@_add("track_summary", sql(f"SELECT {', '.join([*_EXACT, *(q(c, 5) for c in _SHOWN)])} FROM gappy_summary", "gappy_summary"))
def track_summary(spark, d):
    out = gappy_summary(spark, d)
    return out.withColumns({c: r(c, 5) for c in _SHOWN})


def history_sql(summary: str) -> str:
    return f"""SELECT linha, count(flightid) AS n_flights, avg(duration) AS duration_mean, min(duration) AS duration_min,
    max(duration) AS duration_max, stddev_samp(duration) AS duration_std, avg(flightlevel_mean) AS flightlevel_mean,
    avg(flightlevel_max) AS flightlevel_max, avg(distancia) AS distancia, stddev_samp(flightlevel_std) AS flightlevel_std,
    avg(flightlevel_std) AS flightlevel_std1, avg(speed_std) AS speed_std, stddev_samp(speed_std) AS speed_std1
    FROM {summary} JOIN flights USING (flightid) GROUP BY linha"""


_HISTORY = (
    "duration_mean", "duration_min", "duration_max", "duration_std", "flightlevel_mean", "flightlevel_max", "distancia",
    "flightlevel_std", "flightlevel_std1", "speed_std", "speed_std1",
)


@_add(
    "route_history",
    sql(
        f"SELECT linha, n_flights, {', '.join(q(c, 4) for c in _HISTORY)} FROM history",
        "flights", "gappy_summary", history=history_sql("gappy_summary"),
    ),
)
def route_history(spark, d):
    return rounded(tracks.route_history(tracks.with_route(gappy_summary(spark, d), movements(spark, d))), 4)


@_add(
    "flight_target",
    sql(
        """SELECT flightid, origem, destino, linha, target, diaSemana, hora, strftime(dep_hour, '%Y-%m-%d %H') AS dep_hour,
        strftime(arr_hour, '%Y-%m-%d %H') AS arr_hour FROM flights""",
        "flights",
    ),
)
def flight_target(spark, d):
    hours = {c: F.date_format(c, "yyyy-MM-dd HH") for c in ("dep_hour", "arr_hour")}
    return movements(spark, d).drop("dt_dep", "dt_arr").withColumns(hours)


@_add(
    "dedupe_first",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""",
)
def dedupe_first(spark, d):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    lines = s.read(spark, d, "lineitem").select("l_orderkey", "l_quantity", *order)
    return clean.first_per_key(lines, ["l_orderkey"], order).drop("l_shipdate")


@_add(
    "points_with_route",
    sql(
        """SELECT p.flightid, p.dt_radar, f.linha, f.target FROM points p LEFT JOIN flights f USING (flightid)""",
        "points", "flights",
    ),
)
def points_with_route(spark, d):
    flights = movements(spark, d).select("flightid", "linha", "target")
    return skew.skew_join(s.points(spark, d).select("flightid", "dt_radar"), flights, ["flightid"], "left")


_ORDER = ["dt_radar", "lat", "lon", "flightlevel", "speed"]


@_add(
    "track_positions",
    sql(
        """SELECT flightid, dt_radar, lat, lon, row_number() OVER (PARTITION BY flightid
        ORDER BY dt_radar, lat, lon, flightlevel, speed) - 1 AS position FROM points""",
        "points",
    ),
)
def track_positions(spark, d):
    placed = tracks.position_rank(s.points_degrees(spark, d), _ORDER)
    return placed.select("flightid", "dt_radar", "lat", "lon", "position")


@_add(
    "every_nth_point",
    sql(
        """SELECT flightid, dt_radar, lat, lon, flightlevel, speed FROM (SELECT *, row_number() OVER (PARTITION BY flightid
        ORDER BY dt_radar, lat, lon, flightlevel, speed) - 1 AS p FROM points) WHERE p % 7 = 0""",
        "points",
    ),
)
def every_nth_point(spark, d):
    out = tracks.every_nth(s.points_degrees(spark, d), 7, _ORDER)
    return out.select("flightid", "dt_radar", "lat", "lon", "flightlevel", "speed")


@_add(
    "track_first_ts",
    sql(
        """SELECT flightid, dt_radar, min(dt_radar) OVER w AS first_dt_radar, max(dt_radar) OVER w AS last_dt_radar,
        (max(dt_radar) OVER w - min(dt_radar) OVER w) / 1000.0 AS flight_time FROM points WINDOW w AS (PARTITION BY flightid)""",
        "points",
    ),
)
def track_first_ts(spark, d):
    return tracks.with_track_start(s.points(spark, d).select("flightid", "dt_radar"))


@_add(
    "first_value_per_track",
    sql(
        """SELECT flightid, dt_radar, first_level FROM points JOIN (
        SELECT flightid, arg_min(flightlevel, (dt_radar, flightlevel)) AS first_level FROM points GROUP BY flightid) USING (flightid)""",
        "points",
    ),
)
def first_value_per_track(spark, d):
    points = s.points(spark, d).select("flightid", "dt_radar", "flightlevel")
    return tracks.with_first_value(points, "flightlevel", "first_level").drop("flightlevel")


@_add(
    "track_realign",
    sql(
        """SELECT flightid, lat, lon, dt_radar + dt_dep - min(dt_radar) OVER (PARTITION BY flightid) AS dt_radar
        FROM points JOIN movements USING (flightid)""",
        "points", "movements",
    ),
)
def track_realign(spark, d):
    points = s.points_degrees(spark, d).select("flightid", "lat", "lon", "dt_radar")
    return tracks.realign(points, s.movements(spark, d))


_TIMES = "SELECT flightid, (max(dt_radar) - min(dt_radar)) / 1000.0 AS flight_time FROM points GROUP BY flightid"
_TYPICAL = """SELECT linha, arg_min(flightid, (round(abs(flight_time - m) / sd, 9), flightid)) AS flightid
    FROM (SELECT linha, flightid, flight_time, avg(flight_time) OVER (PARTITION BY linha) AS m,
          stddev_samp(flight_time) OVER (PARTITION BY linha) AS sd FROM times JOIN flights USING (flightid))
    WHERE sd > 0 GROUP BY linha"""


def _flight_times(spark, d):
    span = tracks.time_span(s.points(spark, d))
    return span.join(movements(spark, d).select("flightid", "linha"), "flightid").select("linha", "flightid", "flight_time")


@_add(
    "route_spread",
    sql(
        f"""SELECT linha, {q('avg(flight_time)', 6, 'mean')}, {q('stddev_samp(flight_time)', 6, 'std')}
        FROM times JOIN flights USING (flightid) GROUP BY linha""",
        "points", "flights", times=_TIMES,
    ),
)
def route_spread(spark, d):
    return rounded(tracks.route_spread(_flight_times(spark, d)))


@_add("typical_flight", sql("SELECT linha, flightid FROM typical", "points", "flights", times=_TIMES, typical=_TYPICAL))
def typical_flight(spark, d):
    return tracks.typical_flight(_flight_times(spark, d))


_THINNED = """SELECT linha, flightid, dt_radar, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY flightid
    ORDER BY dt_radar, lat, lon) - 1 AS p FROM points) JOIN typical USING (flightid) WHERE p % 2 = 0"""


def _representatives(spark, d):
    points = s.points_degrees(spark, d).select("flightid", "dt_radar", "lat", "lon")
    return synthetic.representative_tracks(points, movements(spark, d), 2)


@_add(
    "representative_tracks",
    sql("SELECT linha, flightid, dt_radar, lat, lon FROM thinned", "points", "flights", times=_TIMES, typical=_TYPICAL, thinned=_THINNED),
)
def representative_tracks(spark, d):
    return _representatives(spark, d).select("linha", "flightid", "dt_radar", "lat", "lon")


@_add(
    "synthetic_tracks",
    sql(
        """SELECT m.flightid, m.origem || m.destino AS linha, m.dt_dep, t.lat, t.lon, t.dt_radar + m.dt_dep - q.s AS dt_radar
        FROM movements m LEFT JOIN thinned t ON t.linha = m.origem || m.destino
        LEFT JOIN (SELECT linha, min(dt_radar) AS s FROM thinned GROUP BY linha) q ON q.linha = m.origem || m.destino""",
        "points", "flights", times=_TIMES, typical=_TYPICAL, thinned=_THINNED,
    ),
)
def synthetic_tracks(spark, d):
    new = s.movements(spark, d).select("flightid", F.concat("origem", "destino").alias("linha"), "dt_dep")
    return synthetic.synthetic_tracks(_representatives(spark, d), new)


@_add(
    "global_order",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part""",
)
def global_order(spark, d):
    part = s.read(spark, d, "part").select("p_partkey", "p_retailprice")
    return positions.position_in_group(part, [], [F.desc("p_retailprice"), "p_partkey"]).drop("p_retailprice")
