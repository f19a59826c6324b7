"""Polygons kept as vertex rows ``(image, poly, vertice, x, y)`` with ordinals 0, 1, 2, …"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .positions import position_in_group
from .skew import skew_join

POLYGON = ("image", "poly")


def unpack_polygons(documents: DataFrame, key: str, json: str) -> DataFrame:
    """Nested JSON ``polygons -> vertices -> [[x, y]]`` to vertex rows, with each polygon's size."""
    shape = F.from_json(json, "array<array<array<array<int>>>>")
    polys = documents.select(F.col(key).alias("image"), F.posexplode(shape).alias("poly", "_ring"))
    size = F.size("_ring").alias("n_vertices")
    vertices = polys.select("image", "poly", size, F.posexplode("_ring").alias("vertice", "_point"))
    point = F.element_at("_point", 1)
    return vertices.select(
        "image", "poly", "vertice", F.element_at(point, 1).alias("x"), F.element_at(point, 2).alias("y"), "n_vertices"
    )


def unpack_log(documents: DataFrame, key: str, json: str) -> DataFrame:
    """Whether each document could be unpacked, with the reason if not."""
    shape = F.from_json(json, "array<array<array<array<int>>>>")
    ok = shape.isNotNull()
    return documents.select(
        F.col(key).alias("image"),
        ok.cast("int").alias("ok"),
        F.when(~ok, F.lit("not a polygon document")).alias("error"),
    )


def renumber(vertices: DataFrame, keys: Sequence[str] = POLYGON, rows_per_task: int | None = None) -> DataFrame:
    """Close gaps in the vertex ordinals (needed only for files that skip numbers)."""
    placed = position_in_group(vertices, list(keys), ["vertice"], "_place", rows_per_task)
    return placed.withColumn("vertice", F.col("_place").cast("int")).drop("_place")


def with_sizes(vertices: DataFrame, keys: Sequence[str] = POLYGON, rows_per_task: int | None = None) -> DataFrame:
    """Add the number of vertices of each polygon, unless the source already gave it."""
    if "n_vertices" in vertices.columns:
        return vertices
    sizes = vertices.groupBy(*keys).agg((F.max("vertice") + 1).alias("n_vertices"))
    return skew_join(vertices, sizes, list(keys), "inner", rows_per_task)


def ring_edges(vertices: DataFrame, keys: Sequence[str] = POLYGON, rows_per_task: int | None = None) -> DataFrame:
    """Edges ``(…keys, vertice, x1, y1, x2, y2)`` of each closed ring with three or more vertices.

    Each vertex is sent out twice, as start of its own edge and as end of the edge before,
    and the two halves meet by (polygon, ordinal). A polygon with very many vertices is
    thus spread over all tasks and no ring is built up in one place.
    """
    keys = list(keys)
    none = F.lit(None).cast("double")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    before = F.pmod(F.col("vertice") - 1, F.col("n_vertices"))

    def half(at, *ends):
        return F.struct(at.alias("vertice"), *[e.alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"))])

    halves = F.array(half(F.col("vertice"), x, y, none, none), half(before, none, none, x, y))
    sized = with_sizes(vertices, keys, rows_per_task).where(F.col("n_vertices") >= 3)
    sent = sized.select(*keys, F.explode(halves).alias("_half")).select(*keys, "_half.*")
    return sent.groupBy(*keys, "vertice").agg(*[F.max(c).alias(c) for c in ("x1", "y1", "x2", "y2")])


def area_and_centroid(edges: DataFrame, keys: Sequence[str] = POLYGON) -> DataFrame:
    """Area and centroid of each ring from sums over its edges.

    A ring without area gets the mean of its vertices as centroid.
    """
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = edges.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.sum(cross).alias("_twice"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("_mx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("_my"),
        F.avg("x1").alias("_ax"),
        F.avg("y1").alias("_ay"),
    )
    flat = F.abs("_twice") < F.lit(1e-12)
    return sums.select(
        *keys,
        "n_vertices",
        (F.abs("_twice") / 2).alias("area"),
        F.when(flat, F.col("_ax")).otherwise(F.col("_mx") / (3 * F.col("_twice"))).alias("centroid_x"),
        F.when(flat, F.col("_ay")).otherwise(F.col("_my") / (3 * F.col("_twice"))).alias("centroid_y"),
    )


def bounding_boxes(vertices: DataFrame, keys: Sequence[str] = POLYGON) -> DataFrame:
    return vertices.groupBy(*keys).agg(
        F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")
    )


def keep_large(areas: DataFrame, smallest: float = 200.0) -> DataFrame:
    return areas.where(F.col("area") >= F.lit(smallest))


def by_size(areas: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Rank of each polygon inside its image, largest first."""
    return position_in_group(areas, ["image"], [F.desc("area"), "poly"], "size_rank", rows_per_task)


def storm_areas(vertices: DataFrame, time, radius=None) -> DataFrame:
    """Storm cells ``(image, poly, image_ts, lat, lon, area, radius_km)`` from cropped-picture vertices.

    ``time`` is the expression giving the picture time. ``radius`` maps the area column to
    kilometres; by default it is half the pixel area, as in the published tables.
    """
    full_x, full_y = geo.uncrop(F.col("x"), F.col("y"))
    areas = area_and_centroid(ring_edges(vertices.withColumns({"x": full_x, "y": full_y})))
    lat, lon = geo.pixel_to_degrees(F.col("centroid_x"), F.col("centroid_y"))
    reach = radius(F.col("area")) if radius else F.col("area") / 2
    return areas.select(
        "image", "poly", time.alias("image_ts"), "centroid_x", "centroid_y",
        lat.alias("lat"), lon.alias("lon"), F.col("area").alias("area_estimate"), reach.alias("radius_km"),
    )
