"""Tracks: one row per radar point, many points per flight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import great_circle_km_atan
from ..functions.numbers import abs_z, time_order
from .positions import position_in_group
from .skew import skew_join

_FOUR = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def degrees_of(points: DataFrame) -> DataFrame:
    """Radar positions come in radians."""
    return points.withColumns({"lat": F.degrees("lat"), "lon": F.degrees("lon")})


def track_summary(points: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per flight: duration, first and last position, level and speed statistics, displacement.

    First and last are the first and last known values; they go by ``order``, a number that grows
    with time; by default the time with the position below it, so that points of the same
    millisecond have a fixed order too. With a plain number as order key every buffer has fixed
    width, so this is one hash aggregation that combines on the map side and never sorts the points.
    """
    at = order
    if at is None:
        at = time_order(F.col("dt_radar"), F.col("lat"), F.col("lon"))
    seen = {c: F.when(F.col(c).isNotNull(), at) for c in ("lat", "lon")}
    known = points.where(F.col("flightid").isNotNull())
    stats = [
        f(c).alias(f"{c}_{n}") for c in ("flightlevel", "speed") for n, f in _FOUR.items()
    ]
    out = known.groupBy("flightid").agg(
        F.count(F.lit(1)).alias("n_points"),
        ((F.max("dt_radar") - F.min("dt_radar")) / F.lit(1000.0)).alias("duration"),
        F.min_by("lat", seen["lat"]).alias("lat_first"),
        F.max_by("lat", seen["lat"]).alias("lat_last"),
        F.min_by("lon", seen["lon"]).alias("lon_first"),
        F.max_by("lon", seen["lon"]).alias("lon_last"),
        *stats,
    )
    span = great_circle_km_atan(F.col("lat_first"), F.col("lon_first"), F.col("lat_last"), F.col("lon_last"))
    return out.withColumn("distancia", span)


def with_route(summary: DataFrame, flights: DataFrame) -> DataFrame:
    """Route of each flight, joined after the points are summed up: one row meets one row."""
    return summary.join(flights.select("flightid", "linha"), "flightid", "left")


def route_history(summary: DataFrame) -> DataFrame:
    """Statistics of the flights of each route."""
    known = summary.where(F.col("linha").isNotNull())
    return known.groupBy("linha").agg(
        F.count("flightid").alias("n_flights"),
        *[f("duration").alias(f"duration_{n}") for n, f in _FOUR.items()],
        F.avg("flightlevel_mean").alias("flightlevel_mean"),
        F.avg("flightlevel_max").alias("flightlevel_max"),
        F.avg("distancia").alias("distancia"),
        F.stddev_samp("flightlevel_std").alias("flightlevel_std"),
        F.avg("flightlevel_std").alias("flightlevel_std1"),
        F.avg("speed_std").alias("speed_std"),
        F.stddev_samp("speed_std").alias("speed_std1"),
    )


def every_nth(
    points: DataFrame,
    n: int = 7,
    order: Sequence[str] = ("dt_radar", "lat", "lon"),
    rows_per_task: int | None = None,
    hot: DataFrame | None | str = "count",
) -> DataFrame:
    """Positions 0, n, 2n, … of each track in time order."""
    placed = position_in_group(points, ["flightid"], list(order), "_position", rows_per_task, hot)
    return placed.where(F.col("_position") % n == 0).drop("_position")


def time_span(points: DataFrame) -> DataFrame:
    """First and last time and their distance in seconds per flight."""
    return points.groupBy("flightid").agg(
        F.min("dt_radar").alias("first_dt_radar"),
        F.max("dt_radar").alias("last_dt_radar"),
        ((F.max("dt_radar") - F.min("dt_radar")) / F.lit(1000.0)).alias("flight_time"),
    )


def with_track_start(points: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Start, end and length of the whole track on each of its points.

    The span is an aggregate joined back, so a very long track is read by many tasks.
    """
    return skew_join(points, time_span(points), ["flightid"], "left", rows_per_task)


def realign(points: DataFrame, departures: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Shift each track in time so that its first point falls on the flight's new departure (``dt_dep``, ms)."""
    shift = time_span(points).join(departures.select("flightid", "dt_dep"), "flightid").select(
        "flightid", (F.col("dt_dep") - F.col("first_dt_radar")).alias("_shift")
    )
    moved = skew_join(points, shift, ["flightid"], "inner", rows_per_task)
    return moved.withColumn("dt_radar", F.col("dt_radar") + F.col("_shift")).drop("_shift")


def route_spread(times: DataFrame) -> DataFrame:
    """Mean and standard deviation of flight time per route."""
    return times.where(F.col("linha").isNotNull()).groupBy("linha").agg(
        F.avg("flight_time").alias("mean"), F.stddev_samp("flight_time").alias("std")
    )


def typical_flight(times: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Per route the flight whose time is nearest to the route's mean; ties go to the smaller id."""
    scored = skew_join(times, route_spread(times), ["linha"], "inner", rows_per_task).select(
        "linha", "flightid", abs_z(F.col("flight_time"), F.col("mean"), F.col("std")).alias("z_score")
    )
    scored = scored.where(F.col("z_score").isNotNull())
    return scored.groupBy("linha").agg(
        F.min_by("flightid", F.struct(F.round("z_score", 9), "flightid")).alias("flightid")
    )


def spread_to_flights(flights: DataFrame, tracks: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Give each flight all points of its route's representative track."""
    points = tracks.drop("flightid")
    return skew_join(flights, points, ["linha"], "left", rows_per_task)


def position_rank(points: DataFrame, order: Sequence[str]) -> DataFrame:
    return position_in_group(points, ["flightid"], list(order))


def with_first_value(points: DataFrame, column: str, name: str, rows_per_task: int | None = None) -> DataFrame:
    """First known value of a column in time order, on every point of the flight; the smallest of equal times."""
    known = points.where(F.col(column).isNotNull())
    first = known.groupBy("flightid").agg(F.min_by(column, F.struct("dt_radar", column)).alias(name))
    return skew_join(points, first, ["flightid"], "left", rows_per_task)
