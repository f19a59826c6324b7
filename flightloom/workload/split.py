"""The queries whose operators spread large groups, once more with so low a limit that the spread path runs, against the same SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containment, exposure, polygons, positions, skew, stats, tracks
from . import exposures, shapes, standins as s, statistics
from . import tracks as track_queries
from .registry import Registry
from .standins import rounded

REGISTRY = Registry()


def _add(of, name: str):
    return REGISTRY.add(f"{name}_split", of.REGISTRY.oracles[name])


@_add(track_queries, "track_positions")
def track_positions(spark, d):
    order = ["dt_radar", "lat", "lon", "flightlevel", "speed"]
    placed = positions.position_in_group(s.points_degrees(spark, d), ["flightid"], order, rows_per_task=4)
    return placed.select("flightid", "dt_radar", "lat", "lon", "position")


@_add(track_queries, "every_nth_point")
def every_nth_point(spark, d):
    order = ["dt_radar", "lat", "lon", "flightlevel", "speed"]
    out = tracks.every_nth(s.points_degrees(spark, d), 7, order, rows_per_task=4)
    return out.select("flightid", "dt_radar", "lat", "lon", "flightlevel", "speed")


@_add(track_queries, "points_with_route")
def points_with_route(spark, d):
    flights = track_queries.movements(spark, d).select("flightid", "linha", "target")
    return skew.skew_join(s.points(spark, d).select("flightid", "dt_radar"), flights, ["flightid"], "left", 4)


@_add(track_queries, "typical_flight")
def typical_flight(spark, d):
    return tracks.typical_flight(track_queries._flight_times(spark, d), 10)


@_add(statistics, "swarm_layout")
def swarm_layout(spark, d):
    events = s.read(spark, d, "events").select("event_id", "value")
    return rounded(stats.swarm_layout(events, "value", "event_id", rows_per_task=5).drop("value"))


@_add(shapes, "polygon_renumbered")
def polygon_renumbered(spark, d):
    gaps = s.vertices(spark, d).drop("n_vertices").withColumn("vertice", F.col("vertice") * 3 + 5)
    return polygons.renumber(gaps, rows_per_task=10)


@_add(exposures, "points_in_polygon")
def points_in_polygon(spark, d):
    out = containment.mark_inside(s.geo_points(spark, d), s.geo_vertices(spark, d), rows_per_task=50)
    return out.select("flightid", "dt_radar", "inside", "copies")


@_add(exposures, "storm_exposure_point")
def storm_exposure_point(spark, d):
    return exposure.point_exposure(s.hourly_points(spark, d), s.storms(spark, d), rows_per_task=50)
