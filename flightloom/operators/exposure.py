"""Which track points lie within reach of a storm cell of the same hour.

A storm's circle is laid out on nested squares, as far as these hold points: a square that lies wholly inside is a count for all its points, at
whatever level it is found; only squares on the rim are divided further, and only points in rim squares of the smallest size are compared
with the storm itself. So a storm that covers half the globe costs some hundred squares and not a row per point. Hits per flight
are counted by hour, on the smallest squares only, without a row per storm and square.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import geo
from ..session import cut_lineage
from .skew import deal, hot_keys, skew_join

KM_PER_DEGREE = geo.EARTH_KM * math.pi / 180.0
#: Sides of the squares in degrees; each square has 64 of the next size.
SIDES = tuple(45.0 / 8**k for k in range(3))
#: Kilometres by which a square must be inside or outside to need no comparison; above the rounding of any distance.
SLACK = 0.001
_CELL = ["hour_ts", "_row", "_col"]
_STORM = ["s_lat", "s_lon", "radius_km"]


def _stand(side: float) -> Column:
    """0 for a square outside of the storm, 1 on its rim, 2 inside: by the distance of the middle and the half diagonal.

    A centre beyond a pole (a polygon at the edge of the picture may have one) is at the same place of the globe.
    """
    lat, lon = F.lit(-90.0) + (F.col("row") + 0.5) * side, F.lit(-180.0) + (F.col("col") + 0.5) * side
    wide = F.cos(F.radians(F.greatest(F.abs(lat) - side / 2, F.lit(0.0))))
    half = side / 2 * F.sqrt(1 + wide * wide) * KM_PER_DEGREE + SLACK
    far = geo.great_circle_km(lat, lon, F.col("s_lat"), F.col("s_lon"))
    radius = F.col("radius_km")
    inside = (far + half <= radius) | (radius > geo.EARTH_KM * math.pi + SLACK)
    return F.when(inside, 2).when(far - half > radius, 0).otherwise(1)


def _judged(met: DataFrame, side: float) -> DataFrame:
    """Rows of squares and storms without those outside; storms that cover a square become one row without a storm, and their number."""
    stand = F.when(F.col("radius_km").isNull(), 2).otherwise(_stand(side))
    met = met.withColumn("_stand", stand).where("_stand > 0")
    storm = [F.when(F.col("_stand") == 1, F.col(c)).alias(c) for c in _STORM]
    return met.select("hour_ts", "row", "col", *storm, "n").groupBy("hour_ts", "row", "col", *_STORM).agg(F.sum("n").alias("n"))


def storms_of_cells(cells: DataFrame, storms: DataFrame) -> DataFrame:
    """(hour, cell, storm, n) for each cell with points: one row without a storm for all that cover it, one for each that may reach into it.

    ``cells``: distinct hour_ts, _row, _col of the smallest squares. From the largest size on, the squares that hold points meet what
    their parent square has met.
    """
    levels = [cells.select("hour_ts", F.col("_row").alias("row"), F.col("_col").alias("col"))]
    for _ in SIDES[1:]:
        levels.append(levels[-1].select("hour_ts", F.shiftright("row", 3).alias("row"), F.shiftright("col", 3).alias("col")).distinct())
    met = _judged(levels.pop().join(_known(storms).withColumn("n", F.lit(1).cast("long")), "hour_ts"), SIDES[0])
    for side in SIDES[1:]:
        above = met.withColumnsRenamed({"row": "_row", "col": "_col"})
        squares = levels.pop().withColumns({"_row": F.shiftright("row", 3), "_col": F.shiftright("col", 3)})
        met = _judged(squares.join(above, _CELL), side)
    return met.withColumnsRenamed({"row": "_row", "col": "_col"})


def _cells(points: DataFrame) -> DataFrame:
    """The points with their smallest square."""
    rows, cols = round(180 / SIDES[-1]), round(360 / SIDES[-1])
    row = F.floor((F.col("lat") + 90.0) / SIDES[-1]).cast("int")
    col = F.floor(F.pmod(F.col("lon") + 180.0, F.lit(360.0)) / SIDES[-1]).cast("int")
    return points.withColumns({"_row": F.least(row, F.lit(rows - 1)), "_col": F.least(col, F.lit(cols - 1))})


def _met(points: DataFrame, storms: DataFrame, rows_per_task: int | None) -> DataFrame:
    """Every point, once for each candidate of its cell or once without one, and ``n``, the storms of that candidate that reach it.

    With ``rows_per_task``, copies of a point become one row first and crowded cells are dealt to several tasks.
    """
    placed = _cells(points)
    copies = F.lit(1).cast("long")
    hot = None
    if rows_per_task:
        placed = placed.groupBy(*placed.columns).agg(F.count("*").alias("_copies"))
        copies = F.col("_copies")
        hot = hot_keys(placed, _CELL, rows_per_task)
    cells = placed.select(_CELL).where("hour_ts IS NOT NULL AND _row IS NOT NULL AND _col IS NOT NULL").distinct()
    candidates = storms_of_cells(cells, storms).withColumnRenamed("n", "_storms")
    pairs = skew_join(placed, candidates, _CELL, "left", rows_per_task, hot=hot)
    near = geo.great_circle_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= F.col("radius_km")
    n = F.when(F.col("_storms").isNotNull() & (F.col("radius_km").isNull() | near), F.col("_storms") * copies).otherwise(F.lit(0))
    return pairs.select(*points.columns, n.cast("long").alias("n"))


def storm_hits(points: DataFrame, storms: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """The points that storms of the same hour reach; the sum of ``n`` over a point's rows is the number of (point, storm) pairs.

    ``points``: lat (within ±90), lon (degrees), hour_ts and any further columns. ``storms``: hour_ts, lat, lon, radius_km.
    """
    return _met(points, storms, rows_per_task).where("n > 0")


_POINT = ["flightid", "dt_radar", "hour_ts", "lat", "lon"]


def _known(storms: DataFrame) -> DataFrame:
    sides = storms.select("hour_ts", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "radius_km")
    return sides.where("hour_ts IS NOT NULL AND radius_km >= 0 AND s_lat IS NOT NULL AND s_lon IS NOT NULL")


def _spans(storms: DataFrame, side: float) -> DataFrame:
    """Storms with a ``row`` of squares: the columns ``_west`` to ``_east`` that a storm may reach there, and ``_from`` to ``_to``, which it covers.

    Columns count on beyond the ends of the globe; none are nulls. The middle of a square is as far as :func:`_stand` allows.
    """
    lat = F.lit(-90.0) + (F.col("row") + 0.5) * side
    wide = F.cos(F.radians(F.greatest(F.abs(lat) - side / 2, F.lit(0.0))))
    half = (side / 2 * F.sqrt(1 + wide * wide) * KM_PER_DEGREE + SLACK) / geo.EARTH_KM
    placed = storms.withColumns(
        {
            "_angle": F.col("radius_km") / geo.EARTH_KM,
            "_half": half,
            "_up": F.sin(F.radians(lat)) * F.sin(F.radians("s_lat")),
            "_flat": F.greatest(F.cos(F.radians(lat)) * F.abs(F.cos(F.radians("s_lat"))), F.lit(1e-15)),
            # A centre beyond a pole lies on the other side of the globe.
            "_lon": F.col("s_lon") + F.when(F.cos(F.radians("s_lat")) < 0, 180.0).otherwise(0.0),
        }
    )
    near, far = F.col("_angle") - F.col("_half"), F.col("_angle") + F.col("_half")
    reach = F.when(far >= math.pi, -2.0).otherwise((F.cos(far) - F.col("_up")) / F.col("_flat"))
    cover = F.when(near >= math.pi, -2.0).when(near >= 0, (F.cos(near) - F.col("_up")) / F.col("_flat"))
    placed = placed.withColumns({"_reach": reach, "_cover": cover})

    def wide_by(c: str, slack: float) -> Column:
        return F.when(F.col(c) <= -1, 360.0).when(F.col(c) <= 1, F.degrees(F.acos(c)) + slack)

    placed = placed.withColumns({"_reach": wide_by("_reach", 1e-6), "_cover": wide_by("_cover", -1e-6)})
    ends = {}
    for west, east, c in (("_west", "_east", "_reach"), ("_from", "_to", "_cover")):
        ends[west] = F.ceil((F.col("_lon") - F.col(c) + 180.0) / side - 0.5)
        ends[east] = F.floor((F.col("_lon") + F.col(c) + 180.0) / side - 0.5)
    return placed.withColumns(ends).drop("_angle", "_half", "_up", "_flat", "_lon", "_reach", "_cover")


def _rows(storms: DataFrame, side: float, low: Column, high: Column) -> DataFrame:
    """Each storm once for each row of squares from ``low`` to ``high`` that it may reach."""
    reach = F.degrees(F.col("radius_km") / geo.EARTH_KM) + 1e-6
    lat = F.degrees(F.asin(F.sin(F.radians("s_lat"))))
    first = F.greatest(low, F.floor((lat - reach + 90.0) / side)).cast("int")
    last = F.least(high, F.floor((lat + reach + 90.0) / side)).cast("int")
    return storms.withColumns({"_low": first, "_high": last}).where("_low <= _high").withColumn("row", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def _bits(west: str, east: str) -> Column:
    """The columns of a row of 64 squares as bits; 0 for none."""
    some = f"shiftrightunsigned(-1L, CAST(63 - {east} + {west} AS INT))"
    at = f"CAST(pmod({west}, 64) AS INT)"
    turned = f"(shiftleft({some}, {at}) | shiftrightunsigned({some}, 64 - {at}))"
    return F.expr(f"CASE WHEN {west} IS NULL OR {east} < {west} THEN 0L WHEN {east} - {west} >= 63 THEN -1L ELSE {turned} END")


def _within(df: DataFrame, covered: DataFrame, row: Column, col: Column) -> DataFrame:
    """The rows with ``_in``, whether their square is among the covered ones, which come as one row of 64 bits per hour and row."""
    bits = covered.select("hour_ts", F.col("row").alias("_r"), "_bits")
    joined = df.withColumns({"_r": row, "_c": col}).join(bits, ["hour_ts", "_r"], "left")
    bit = F.expr("shiftright(_bits, _c) & 1")
    return joined.withColumn("_in", F.coalesce(bit == 1, F.lit(False))).drop("_r", "_c", "_bits")


def point_exposure(points: DataFrame, storms: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Per (flight, time): 1 if any storm of the hour reaches the point, else 0.

    A square that some storm covers is settled for all its points, whatever else reaches into it: the squares of middle size are 64 bits per
    hour and row, and only in squares that no storm covers are storms laid out on the smallest squares and compared with points.
    """
    middle, small = SIDES[-2], SIDES[-1]
    parts = round(middle / small)
    # Few large files would leave the storms to few tasks.
    known = _known(storms).repartition("hour_ts", "s_lat", "s_lon")
    laid = _spans(_rows(known, middle, F.lit(0), F.lit(round(180 / middle) - 1)), middle)
    laid = laid.select("hour_ts", "row", *_STORM, _bits("_west", "_east").alias("_met"), _bits("_from", "_to").alias("_bits"))
    covered = cut_lineage(laid.where("_bits != 0").groupBy("hour_ts", "row").agg(F.bit_or("_bits").alias("_bits")))
    rim = laid.drop("_bits").join(covered, ["hour_ts", "row"], "left")
    rim = rim.withColumn("_met", F.expr("_met & ~coalesce(_bits, 0L)")).where("_met != 0").withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rim = rim.where(F.expr("shiftright(_met, _at) & 1") == 1).withColumn("_row", F.col("row"))
    spans = _spans(_rows(rim.drop("row"), small, F.col("_row") * parts, F.col("_row") * parts + parts - 1), small)
    each = spans.withColumn("_col", F.explode(F.sequence(F.col("_at") * parts, F.col("_at") * parts + parts - 1)))
    n_cols = F.lit(round(360 / small))

    def among(west: str, east: str) -> Column:
        return F.coalesce(F.pmod(F.col("_col") - F.col(west), n_cols) <= F.col(east) - F.col(west), F.lit(False))

    each = each.where(among("_west", "_east"))
    storm = [F.when(~among("_from", "_to"), F.col(c)).alias(c) for c in _STORM]
    near = each.select("hour_ts", F.col("row").alias("_row"), "_col", *storm, F.lit(True).alias("_met")).distinct()

    placed = _within(_cells(points.select(_POINT)), covered, F.floor(F.col("_row") / parts).cast("int"), F.floor(F.col("_col") / parts).cast("int"))
    settled = placed.where("_in").select("flightid", "dt_radar", F.lit(1).alias("hit"))
    open_ = placed.where("NOT _in").drop("_in")
    hot = None
    if rows_per_task:
        open_ = open_.distinct()
        hot = hot_keys(open_, _CELL, rows_per_task)
    pairs = skew_join(open_, near, _CELL, "left", rows_per_task, hot=hot)
    reached = geo.great_circle_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon")) <= F.col("radius_km")
    hit = F.when(F.col("_met") & (F.col("radius_km").isNull() | reached), 1).otherwise(0)
    every = settled.unionByName(pairs.select("flightid", "dt_radar", hit.alias("hit")))
    return every.groupBy("flightid", "dt_radar").agg(F.max("hit").alias("flight_through_area"))


#: Points of an hour, and storms of an hour, that one task solves at once; comparisons and (storm, row of squares) held at a time.
HOUR_ROWS = 500_000
_PAIRS, _SPANS = 1_000_000, 200_000


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position as often as its count says, and the number of each repetition from 0 on."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def _unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def _span(middle, half, side, angle, s_lat, lon):
    """First and last columns that a storm may reach in a row of squares, and those it covers; see :func:`_spans`. No columns: last before first."""
    up = np.sin(middle) * np.sin(s_lat)
    flat = np.maximum(np.cos(middle) * np.abs(np.cos(s_lat)), 1e-15)
    ends = []
    for a, slack in ((angle + half, 1e-6), (angle - half, -1e-6)):
        c = np.where(a >= math.pi, -2.0, (np.cos(a) - up) / flat)
        wide = np.where(c <= -1, 360.0, np.degrees(np.arccos(np.clip(c, -1, 1))) + slack)
        none = (c > 1) | (a < 0)
        ends.append(np.where(none, 0, np.ceil((lon - wide + 180.0) / side - 0.5)).astype(np.int64))
        ends.append(np.where(none, -1, np.floor((lon + wide + 180.0) / side - 0.5)).astype(np.int64))
    return ends


def storms_at(lat: np.ndarray, lon: np.ndarray, s_lat: np.ndarray, s_lon: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each point the number of storms that reach it.

    Points are sorted by row and column of the smallest squares, so neighbouring squares of a row are one run of points. A storm adds one to
    all squares of a row that it covers, by the ends of that span; points on its rim are compared with it.
    """
    every = np.isnan(radius) | (radius > geo.EARTH_KM * math.pi + SLACK)
    total = np.full(len(lat), int(every.sum()), np.int64)
    fine = np.flatnonzero(np.isfinite(lat) & np.isfinite(lon))
    storm = ~every & np.isfinite(s_lat) & np.isfinite(s_lon)
    if not len(fine) or not storm.any():
        return total
    s_lat, s_lon, radius = s_lat[storm], s_lon[storm], radius[storm]
    side = SIDES[-1]
    rows, cols = round(180 / side), round(360 / side)
    row = np.clip(np.floor((lat[fine] + 90.0) / side), 0, rows - 1).astype(np.int64)
    col = np.minimum(np.floor(np.mod(lon[fine] + 180.0, 360.0) / side).astype(np.int64), cols - 1)
    order = np.argsort(row * cols + col, kind="stable")
    cell = (row * cols + col)[order]
    fine = fine[order]
    lat, lon = lat[fine], lon[fine]
    starts = np.append(0, np.cumsum(np.bincount(cell, minlength=rows * cols)))
    at = _unit(lat, lon)
    centre, angle = _unit(s_lat, s_lon), radius / geo.EARTH_KM
    least = np.cos(angle)
    # A centre beyond a pole lies on the other side of the globe.
    turned = s_lon + np.where(np.cos(np.radians(s_lat)) < 0, 180.0, 0.0)
    place = np.arcsin(np.clip(np.sin(np.radians(s_lat)), -1, 1))
    reach = np.degrees(angle) + 1e-6
    first = np.clip(np.floor((np.degrees(place) - reach + 90.0) / side), row.min(), rows - 1).astype(np.int64)
    last = np.clip(np.floor((np.degrees(place) + reach + 90.0) / side), 0, row.max()).astype(np.int64)
    spans = np.maximum(last - first + 1, 0)
    upto = np.cumsum(spans)
    covered = np.zeros((rows, 2 * cols + 1), np.int64)
    hits = np.zeros(len(lat), np.int64)
    done = 0
    while done < len(spans):
        before = upto[done] - spans[done]
        some = max(done + 1, int(np.searchsorted(upto, before + _SPANS, "right")))
        k, nth = _repeated(spans[done:some])
        k += done
        r = first[k] + nth
        filled = starts[(r + 1) * cols] > starts[r * cols]
        k, r = k[filled], r[filled]
        middle = -90.0 + (r + 0.5) * side
        wide = np.cos(np.radians(np.maximum(np.abs(middle) - side / 2, 0.0)))
        half = (side / 2 * np.sqrt(1 + wide * wide) * KM_PER_DEGREE + SLACK) / geo.EARTH_KM
        west, east, low, high = _span(np.radians(middle), half, side, angle[k], np.radians(s_lat)[k], turned[k])
        size = np.clip(high - low + 1, 0, cols)
        inner = size > 0
        np.add.at(covered, (r[inner], low[inner] % cols), 1)
        np.add.at(covered, (r[inner], low[inner] % cols + size[inner]), -1)
        around = east - west + 1 >= cols
        # What is reached and not covered: one run of columns or two.
        begin = np.where(inner & around, high + 1, west)
        number = np.where(inner, np.where(around, cols - size, low - west), np.minimum(east - west + 1, cols))
        second = np.where(inner & ~around, east - high, 0)
        k, r = np.concatenate([k, k]), np.concatenate([r, r])
        begin, number = np.concatenate([begin, high + 1]) % cols, np.maximum(np.concatenate([number, second]), 0)
        # Runs over the end of the row go on at its beginning.
        over = np.maximum(begin + number - cols, 0)
        a = np.concatenate([starts[r * cols + begin], starts[r * cols]])
        b = np.concatenate([starts[r * cols + begin + number - over], starts[r * cols + over]])
        some_points = np.flatnonzero(b > a)
        _rim(hits, (lat, lon, at), np.concatenate([k, k])[some_points], a[some_points], (b - a)[some_points], (s_lat, s_lon, radius, centre, least))
        done = some
    inside = np.cumsum(covered, axis=1)
    hits += (inside[:, :cols] + inside[:, cols : 2 * cols]).reshape(-1)[cell]
    total[fine] += hits
    return total


def _rim(hits: np.ndarray, points: tuple, storm: np.ndarray, start: np.ndarray, count: np.ndarray, storms: tuple) -> None:
    """Adds the storms of each run of points that reach its points: by the cosine of the angle between them, close cases by the distance itself."""
    lat, lon, at = points
    s_lat, s_lon, radius, centre, least = storms
    upto = np.cumsum(count)
    done = 0
    while done < len(count):
        some = max(done + 1, int(np.searchsorted(upto, upto[done] - count[done] + _PAIRS, "right")))
        which, nth = _repeated(count[done:some])
        p, k = np.repeat(start[done:some], count[done:some]) + nth, storm[done:some]
        more = sum(at[i][p] * centre[i][k][which] for i in range(3)) - least[k][which]
        near = more > 0
        close = np.flatnonzero(np.abs(more) < 1e-9)
        if len(close):
            q, s = p[close], k[which[close]]
            high, wide = np.sin(np.radians(s_lat[s] - lat[q]) / 2), np.sin(np.radians(s_lon[s] - lon[q]) / 2)
            chord = high * high + np.cos(np.radians(lat[q])) * np.cos(np.radians(s_lat[s])) * wide * wide
            near[close] = 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.clip(chord, 0.0, 1.0))) <= radius[s]
        found = p[near]
        if len(found):
            low = found.min()
            n = np.bincount(found - low)
            hits[low : low + len(n)] += n
        done = some


def _hits_by_flight(here: pa.Table, storms: pa.Table) -> pa.Table:
    """(flightid, hour, number of (point, storm) pairs) of the points and storms of one hour."""
    known = np.asarray(pc.and_(pc.is_valid(here["lat"]), pc.is_valid(here["lon"])))
    lat, lon = (here[c].to_numpy()[known] for c in ("lat", "lon"))
    n = np.zeros(here.num_rows, np.int64)
    n[known] = storms_at(lat, lon, *(storms[c].to_numpy() for c in ("s_lat", "s_lon", "radius_km"))) if storms.num_rows else 0
    counted = pa.table({"flightid": here["flightid"], "hour_ts": here["hour_ts"], "n": pa.array(n * here["_copies"].to_numpy())})
    return counted.group_by(["flightid", "hour_ts"]).aggregate([("n", "sum")]).select(["flightid", "hour_ts", "n_sum"]).rename_columns(["flightid", "hour_ts", "n"])


def flight_exposure(points: DataFrame, storms: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Per flight: number of (point, storm) hits and the first hour in which there was any storm.

    Points and storms are shuffled once, by hour, and solved there; hours with very many of either are dealt to several tasks.
    """
    limit = rows_per_task or HOUR_ROWS
    here = points.select("flightid", "hour_ts", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon")))
    cells, at = _known(storms).withColumns({c: F.col(c).cast("double") for c in _STORM}), ["hour_ts"]
    many_points, many_storms = hot_keys(here, at, limit), hot_keys(cells, at, limit)
    if many_points is not None:
        here, cells = (d.withColumnRenamed("_slice", "_of_points") for d in deal(here, cells, ["hour_ts"], many_points, limit))
        at.append("_of_points")
    if many_storms is not None:
        cells, here = (d.withColumnRenamed("_slice", "_of_storms") for d in deal(cells, here, ["hour_ts"], many_storms, limit))
        at.append("_of_storms")
    once = here.repartition(*at).groupBy(*here.columns).agg(F.count(F.lit(1)).alias("_copies"))
    schema = StructType([points.schema["flightid"], points.schema["hour_ts"], StructField("n", LongType())])
    hours = once.groupBy(*at).cogroup(cells.groupBy(*at)).applyInArrow(_hits_by_flight, schema)
    stormy = storms.select("hour_ts", F.lit(True).alias("_stormy")).distinct()
    hours = skew_join(hours, stormy, ["hour_ts"], "left", rows_per_task)
    return hours.groupBy("flightid").agg(
        F.sum("n").alias("flight_through_area"), F.min(F.when(F.col("_stormy"), F.col("hour_ts"))).alias("first_storm_hour")
    )


def total_exposure(exposed_points: DataFrame) -> DataFrame:
    """Number of exposed points per flight, one row per flight for the feature join."""
    total = F.sum("flight_through_area").alias("sum(flight_through_area)")
    return exposed_points.groupBy("flightid").agg(total)
