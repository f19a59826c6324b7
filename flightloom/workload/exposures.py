"""Queries on storm exposure and points in polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import containment, exposure
from ..plans import storms
from . import standins as s
from .registry import Registry
from .standins import sql

REGISTRY = Registry()
_add = REGISTRY.add

# The checks compare each point with every storm of its hour.
_NEAR = """SELECT p.flightid, p.dt_radar, s.event_id FROM points p JOIN storms s
    ON date_trunc('hour', make_timestamp(p.dt_radar * 1000)) = s.hour_ts
    AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - p.lat) / 2), 2)
        + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) <= s.radius_km"""
_PER_POINT = """SELECT flightid, dt_radar, max(CASE WHEN n.flightid IS NULL THEN 0 ELSE 1 END) AS flight_through_area
    FROM (SELECT flightid, dt_radar FROM points) LEFT JOIN near n USING (flightid, dt_radar) GROUP BY 1, 2"""


@_add("storm_exposure_point", sql("SELECT * FROM exposed", "points", "storms", near=_NEAR, exposed=_PER_POINT.replace("n.flightid", "n.event_id")))
def storm_exposure_point(spark, d):
    return exposure.point_exposure(s.hourly_points(spark, d), s.storms(spark, d))


@_add(
    "storm_exposure_total",
    sql(
        'SELECT flightid, CAST(sum(flight_through_area) AS BIGINT) AS "sum(flight_through_area)" FROM exposed GROUP BY 1',
        "points", "storms", near=_NEAR, exposed=_PER_POINT.replace("n.flightid", "n.event_id"),
    ),
)
def storm_exposure_total(spark, d):
    return storms.training_exposure(s.points(spark, d), s.storms(spark, d))


@_add(
    "storm_exposure_flight",
    sql(
        """SELECT flightid, coalesce(hits, 0) AS flight_through_area, strftime(first, '%Y-%m-%d %H') AS first_storm_hour
        FROM (SELECT flightid, min(hour_ts) AS first FROM (SELECT flightid, date_trunc('hour', make_timestamp(dt_radar * 1000)) AS h FROM points)
              LEFT JOIN (SELECT DISTINCT hour_ts FROM storms) ON h = hour_ts GROUP BY 1)
        LEFT JOIN (SELECT flightid, count(*) AS hits FROM near GROUP BY 1) USING (flightid)""",
        "points", "storms", near=_NEAR,
    ),
)
def storm_exposure_flight(spark, d):
    out = storms.scoring_exposure(s.points(spark, d), s.storms(spark, d))
    return out.withColumn("first_storm_hour", F.date_format("first_storm_hour", "yyyy-MM-dd HH"))


@_add(
    "points_in_polygon",
    sql("SELECT flightid, dt_radar, inside, copies FROM marked", "marked"),
)
def points_in_polygon(spark, d):
    out = containment.mark_inside(s.geo_points(spark, d), s.geo_vertices(spark, d))
    return out.select("flightid", "dt_radar", "inside", "copies")


@_add(
    "inside_per_flight",
    sql(
        "SELECT flightid, CAST(sum(inside * copies) AS BIGINT) AS inside, CAST(sum(copies) AS BIGINT) AS points FROM marked GROUP BY 1", "marked"
    ),
)
def inside_per_flight(spark, d):
    return containment.hits_per_flight(containment.mark_inside(s.geo_points(spark, d), s.geo_vertices(spark, d)))


@_add(
    "polygon_hits",
    sql(
        """SELECT bucket, poly, CAST(coalesce(points, 0) AS BIGINT) AS points, CASE WHEN points > 0 THEN 1 ELSE 0 END AS hit
        FROM (SELECT DISTINCT bucket, poly FROM geo_edges)
        LEFT JOIN (SELECT bucket, poly, sum(copies) AS points FROM contained GROUP BY 1, 2) USING (bucket, poly)""",
        "contained",
    ),
)
def polygon_hits(spark, d):
    return containment.polygons_hit(s.geo_points(spark, d), s.geo_vertices(spark, d))


_BEST = """SELECT flightid, CAST(sum(inside * copies) AS BIGINT) AS inside, CAST(sum(copies) AS BIGINT) AS points
    FROM marked GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 1"""


@_add("most_exposed", sql(_BEST, "marked"))
def most_exposed(spark, d):
    return containment.most_exposed(containment.mark_inside(s.geo_points(spark, d), s.geo_vertices(spark, d)))


@_add(
    "route_overlay",
    sql(
        """SELECT flightid, dt_radar, lon, lat, bucket, inside, CAST(dt_radar = min(dt_radar) OVER () AS INT) AS is_start,
        CAST(dt_radar = max(dt_radar) OVER () AS INT) AS is_end FROM marked WHERE flightid IN (SELECT flightid FROM best)""",
        "marked", best=_BEST,
    ),
)
def route_overlay(spark, d):
    points, vertices = s.geo_points(spark, d), s.geo_vertices(spark, d)
    return containment.overlay(points, vertices, containment.most_exposed(containment.mark_inside(points, vertices)))


@_add(
    "route_hit_polygons",
    sql(
        """SELECT bucket, poly, CAST(sum(copies) AS BIGINT) AS points FROM contained
        WHERE flightid IN (SELECT flightid FROM best) GROUP BY 1, 2""",
        "marked", best=_BEST,
    ),
)
def route_hit_polygons(spark, d):
    points, vertices = s.geo_points(spark, d), s.geo_vertices(spark, d)
    return containment.overlay_polygons(points, vertices, containment.most_exposed(containment.mark_inside(points, vertices)))


_WINDOW = "dt_radar >= 1704844800000 AND dt_radar < 1704844800000 + 6 * 3600000"


@_add(
    "most_exposed_hour",
    sql(
        f"""SELECT flightid, dt_radar, lon, lat, inside, CAST(dt_radar = min(dt_radar) OVER () AS INT) AS is_start,
        CAST(dt_radar = max(dt_radar) OVER () AS INT) AS is_end FROM marked WHERE {_WINDOW} AND flightid IN (SELECT flightid FROM best)""",
        "marked", best=_BEST.replace("FROM marked", f"FROM marked WHERE {_WINDOW}"),
    ),
)
def most_exposed_hour(spark, d):
    """The flight with most points in storm polygons within six hours from 2024-01-10, and its points in them."""
    points = s.geo_points(spark, d).withColumn("dt_radar", F.timestamp_millis("dt_radar"))
    _, shown = storms.most_exposed_flight(points, s.geo_vertices(spark, d), "2024-01-10 00:00:00", 6)
    return shown.withColumn("dt_radar", F.unix_millis("dt_radar")).drop("bucket")
