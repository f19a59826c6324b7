"""Queries on polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import polygons, proximity
from . import standins as s
from .registry import Registry
from .standins import q, r, rounded, sql

REGISTRY = Registry()
_add = REGISTRY.add

_JSON = """SELECT vec_id || '.jpg' AS image, CAST(p AS INT) AS poly, CAST(v AS INT) AS vertice,
    CAST(floor(embedding[p * 16 + v * 2 + 1]::DOUBLE * 1000) + 500 AS INT) AS x,
    CAST(floor(embedding[p * 16 + v * 2 + 2]::DOUBLE * 1000) + 500 AS INT) AS y
    FROM embeddings, range(4) AS a(p), range(8) AS b(v)"""


@_add("json_vertices", _JSON)
def json_vertices(spark, d):
    return polygons.unpack_polygons(s.polygon_documents(spark, d), "data", "json").drop("n_vertices")


@_add("json_log", """SELECT vec_id || '.jpg' AS image, CASE WHEN vec_id % 10 = 0 THEN 0 ELSE 1 END AS ok,
    CASE WHEN vec_id % 10 = 0 THEN 'not a polygon document' END AS error FROM embeddings""")
def json_log(spark, d):
    bad = F.col("data").endswith("0.jpg")
    docs = s.polygon_documents(spark, d).withColumn("json", F.when(bad, F.lit("{broken")).otherwise(F.col("json")))
    return polygons.unpack_log(docs, "data", "json")


_EDGES = """SELECT a.image, a.poly, a.vertice, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
    FROM {v} a JOIN {v} b ON a.image = b.image AND a.poly = b.poly AND b.vertice = (a.vertice + 1) % {n}"""
_AREAS = """SELECT image, poly, count(*) AS n_vertices, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area,
    CASE WHEN abs(sum(x1 * y2 - x2 * y1)) < 1e-12 THEN avg(x1) ELSE sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) END AS centroid_x,
    CASE WHEN abs(sum(x1 * y2 - x2 * y1)) < 1e-12 THEN avg(y1) ELSE sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) END AS centroid_y
    FROM edges GROUP BY image, poly"""


@_add(
    "polygon_ring",
    sql(f"SELECT image, poly, vertice, {', '.join(q(c, 9) for c in ('x1', 'y1', 'x2', 'y2'))} FROM edges",
        "vertices", edges=_EDGES.format(v="vertices", n=32)),
)
def polygon_ring(spark, d):
    return rounded(polygons.ring_edges(s.vertices(spark, d).drop("n_vertices")), 9)


@_add(
    "polygon_area_centroid",
    sql(f"SELECT image, poly, n_vertices, {q('area', 6)}, {q('centroid_x', 5)}, {q('centroid_y', 5)} FROM areas",
        edges=f"SELECT image, poly, vertice, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM ({_EDGES.format(v=f'({_JSON})', n=8)})",
        areas=_AREAS),
)
def polygon_area_centroid(spark, d):
    vertices = polygons.unpack_polygons(s.polygon_documents(spark, d), "data", "json")
    out = polygons.area_and_centroid(polygons.ring_edges(vertices))
    return out.withColumns({"area": r("area"), "centroid_x": r("centroid_x", 5), "centroid_y": r("centroid_y", 5)})


@_add(
    "polygon_bbox",
    sql("SELECT image, poly, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM vertices GROUP BY image, poly", "vertices"),
)
def polygon_bbox(spark, d):
    return polygons.bounding_boxes(s.vertices(spark, d))


_PIXEL_AREAS = {
    "edges": f"SELECT image, poly, vertice, x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM ({_EDGES.format(v='pixel_vertices', n=32)})",
    "areas": _AREAS,
}


def _areas(spark, d):
    return polygons.area_and_centroid(polygons.ring_edges(s.pixel_vertices(spark, d)))


@_add(
    "large_polygons",
    sql(f"SELECT image, poly, {q('area', 4)} FROM areas WHERE area >= 20000", "pixel_vertices", **_PIXEL_AREAS),
)
def large_polygons(spark, d):
    return polygons.keep_large(_areas(spark, d), 20000).select("image", "poly", r("area", 4).alias("area"))


@_add(
    "polygon_size_rank",
    sql(
        "SELECT image, poly, row_number() OVER (PARTITION BY image ORDER BY area DESC, poly) - 1 AS size_rank FROM areas",
        "pixel_vertices", **_PIXEL_AREAS,
    ),
)
def polygon_size_rank(spark, d):
    return polygons.by_size(_areas(spark, d)).select("image", "poly", "size_rank")


@_add(
    "polygon_renumbered",
    sql("SELECT image, poly, vertice, x, y FROM vertices", "vertices"),
)
def polygon_renumbered(spark, d):
    gaps = s.vertices(spark, d).drop("n_vertices").withColumn("vertice", F.col("vertice") * 3 + 5)
    return polygons.renumber(gaps)


_LAT = "8.0 + ({y} - 740.0) * ((-51.848798 - 8.0) / (2192.0 - 740.0))"
_LON = "-76.538633 + ({x} - 940.0) * ((-28.966528 + 76.538633) / (2092.0 - 940.0))"


@_add(
    "pixel_to_geo",
    sql(
        f"SELECT image, poly, vertice, {q(_LAT.format(y='(y + 740)::DOUBLE'), 6, 'lat')}, {q(_LON.format(x='(x + 940)::DOUBLE'), 6, 'lon')} FROM pixel_vertices",
        "pixel_vertices",
    ),
)
def pixel_to_geo(spark, d):
    x, y = geo.uncrop(F.col("x"), F.col("y"))
    lat, lon = geo.pixel_to_degrees(x, y)
    return s.pixel_vertices(spark, d).select("image", "poly", "vertice", r(lat).alias("lat"), r(lon).alias("lon"))


@_add(
    "storm_areas",
    sql(
        f"""SELECT image, poly, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(image AS INT)), '%Y-%m-%d %H:%M') AS at,
        {q(_LAT.format(y='(centroid_y + 740)'), 4, 'lat')}, {q(_LON.format(x='(centroid_x + 940)'), 4, 'lon')},
        {q('area', 4, 'area_estimate')}, {q('area / 2', 4, 'radius_km')} FROM areas""",
        "pixel_vertices", **_PIXEL_AREAS,
    ),
)
def storm_areas(spark, d):
    at = F.timestamp_millis(F.lit(s.START_MS) + F.col("image") * 3600000)
    out = polygons.storm_areas(s.pixel_vertices(spark, d), at)
    out = out.select("image", "poly", F.date_format("image_ts", "yyyy-MM-dd HH:mm").alias("at"), "lat", "lon", "area_estimate", "radius_km")
    return rounded(out, 4)


@_add(
    "distances",
    sql(
        f"""SELECT event_id, {q('''2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2)
        + cos(radians(10.0)) * cos(radians(lat)) * pow(sin(radians(lon + 40) / 2), 2)))''', 4, 'km')},
        {q('sqrt(pow(lat - 10, 2) + pow(lon + 40, 2))', 6, 'flat')}
        FROM (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE lat END AS lat, CASE WHEN event_id % 17 = 0 THEN NULL ELSE lon END AS lon
              FROM storms)""",
        "storms",
    ),
)
def distances(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    lat, lon = ((u * 37 + e) % 140 - 70).cast("double"), (e * 53 % 340 - 170).cast("double")
    lat, lon = F.when(e % 13 != 0, lat), F.when(e % 17 != 0, lon)
    return s.read(spark, d, "events").select(
        "event_id",
        r(geo.great_circle_km(F.lit(10.0), F.lit(-40.0), lat, lon), 4).alias("km"),
        r(geo.pixel_distance(F.lit(10.0), F.lit(-40.0), lat, lon)).alias("flat"),
    )


SPREAD = 18000


def _spread_vertices(spark, d):
    return s.pixel_vertices(spark, d, SPREAD, 10000)


_COMPONENTS = dict(
    px=f"SELECT image, poly, CAST(floor(x * {SPREAD}) AS INT) AS x, CAST(floor(y * {SPREAD}) AS INT) AS y FROM vertices",
    near="""SELECT DISTINCT a.image, a.poly, b.poly AS other FROM px a JOIN px b ON a.image = b.image
        AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400""",
    reach="""SELECT image, poly, other FROM near
        UNION SELECT r.image, r.poly, n.other FROM reach r JOIN near n ON r.image = n.image AND r.other = n.poly""",
)


@_add(
    "proximity_components",
    sql("SELECT image, poly, min(other) AS component FROM reach GROUP BY image, poly", "vertices", **_COMPONENTS),
)
def proximity_components(spark, d):
    return proximity.proximity_components(_spread_vertices(spark, d))


# A pixel is a corner if the directions to all others leave a gap of more than half a turn; corners are ordered
# by their direction from the leftmost one.
_CORNERS = dict(
    pixels="""SELECT DISTINCT image, component, x::BIGINT + 10000 AS x, y::BIGINT + 10000 AS y
        FROM px JOIN (SELECT image, poly, min(other) AS component FROM reach GROUP BY image, poly) USING (image, poly)""",
    ways="""SELECT a.*, atan2(b.y - a.y, b.x - a.x) AS way FROM pixels a JOIN pixels b
        ON a.image = b.image AND a.component = b.component AND (a.x <> b.x OR a.y <> b.y)""",
    gaps="""SELECT image, component, x, y, coalesce(lead(way) OVER w, first_value(way) OVER w + 2 * pi()) - way AS gap
        FROM ways WINDOW w AS (PARTITION BY image, component, x, y ORDER BY way)""",
    corners="""SELECT image, component, x, y FROM gaps GROUP BY ALL HAVING max(gap) > pi() + 1e-12
        UNION SELECT image, component, min(x), min(y) FROM pixels GROUP BY image, component HAVING count(*) = 1""",
    starts="SELECT image, component, min(x) AS x0, arg_min(y, (x, y)) AS y0 FROM corners GROUP BY image, component",
)


@_add(
    "proximity_hulls",
    sql(
        """SELECT image, component, CAST(row_number() OVER (PARTITION BY image, component
        ORDER BY x <> x0 OR y <> y0, atan2(y - y0, x - x0)) - 1 AS INT) AS vertice, x, y FROM corners JOIN starts USING (image, component)""",
        "vertices", **_COMPONENTS, **_CORNERS,
    ),
)
def proximity_hulls(spark, d):
    vertices = _spread_vertices(spark, d)
    return proximity.proximity_hulls(vertices, proximity.proximity_components(vertices))
