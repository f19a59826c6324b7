"""Storm exposure of flights, from picture polygons and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..operators import containment, exposure, polygons
from ..operators.tracks import degrees_of
from ..session import cut_lineage


def storms_by_hour(vertices: DataFrame, time, radius=None) -> DataFrame:
    """Storm cells keyed by hour, ready for the exposure joins."""
    cells = polygons.storm_areas(vertices, time, radius)
    return cells.withColumn("hour_ts", times.hour_bucket(F.col("image_ts")))


def track_points(points: DataFrame) -> DataFrame:
    """Radar points in degrees with their hour."""
    at = times.from_epoch_ms(F.col("dt_radar"))
    return degrees_of(points).withColumn("hour_ts", times.hour_bucket(at))


def training_exposure(points: DataFrame, storms: DataFrame) -> DataFrame:
    """Exposed points per flight, counting each point once."""
    return exposure.total_exposure(exposure.point_exposure(track_points(points), storms))


def scoring_exposure(points: DataFrame, storms: DataFrame) -> DataFrame:
    """Hits per flight and the first stormy hour."""
    return exposure.flight_exposure(track_points(points), storms)


def most_exposed_flight(points: DataFrame, vertices: DataFrame, start: str, hours: int = 1, size: float = 2.5):
    """The flight of the window with most points in storm polygons, and its annotated points.

    ``points``: flightid, dt_radar (timestamp), lon, lat, bucket. ``vertices``: bucket, poly, vertice, x, y.
    """
    begin = F.lit(start).cast(points.schema["dt_radar"].dataType)
    window = points.where((F.col("dt_radar") >= begin) & (F.col("dt_radar") < times.add_hours(begin, hours)))
    best = cut_lineage(containment.most_exposed(containment.mark_inside(window, vertices, size=size)))
    named = best.first()
    if named is None:
        raise ValueError("no track points in the window")
    return named["flightid"], containment.overlay(window, vertices, best, size)
