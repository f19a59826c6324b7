"""Column expressions on coordinates, all inside code generation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    s_lat = F.sin(F.radians(lat2 - lat1) / 2)
    s_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    # Rounding may leave [0, 1] for the same and for opposite points; an unknown place has no distance.
    return F.when(a.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), a)))


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    return 2 * EARTH_KM * F.asin(F.sqrt(_half_chord(lat1, lon1, lat2, lon2)))


def great_circle_km_atan(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The same distance through atan2, steadier for opposite points."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def pixel_distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


@dataclass(frozen=True)
class Axis:
    """A straight line through two (pixel, degree) knots; it goes on outside of them."""

    pixel_a: float
    degree_a: float
    pixel_b: float
    degree_b: float

    def degrees(self, pixel: Column) -> Column:
        slope = (self.degree_b - self.degree_a) / (self.pixel_b - self.pixel_a)
        return F.lit(self.degree_a) + (pixel - F.lit(self.pixel_a)) * F.lit(slope)


# Corner control points of the satellite picture (pixel row/column, degrees).
LAT_AXIS = Axis(740.0, 8.0, 2192.0, -51.848798)
LON_AXIS = Axis(940.0, -76.538633, 2092.0, -28.966528)
# Columns and rows cut off the left and top of the picture.
CROP_X, CROP_Y = 940, 740


def uncrop(x: Column, y: Column) -> tuple[Column, Column]:
    return x + F.lit(CROP_X), y + F.lit(CROP_Y)


def pixel_to_degrees(x: Column, y: Column, lat_axis: Axis = LAT_AXIS, lon_axis: Axis = LON_AXIS) -> tuple[Column, Column]:
    """(lat, lon) of a full-picture pixel: rows give latitude, columns longitude."""
    return lat_axis.degrees(y), lon_axis.degrees(x)


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def ray_crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """True if the ray from (px, py) toward growing x meets the edge (even-odd rule)."""
    return ((y1 > py) != (y2 > py)) & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1)
