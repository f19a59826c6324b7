"""Points in polygons, by crossing edges."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..session import cut_lineage
from .polygons import ring_edges
from .skew import deal, hot_keys, skew_join

_CELL = ["bucket", "_cx", "_cy"]

# Slack when an edge is called left or right of a whole square.
_SLACK = 1e-9

#: Points of a square that one task solves at once, and comparisons of points and edges held at a time.
SQUARE_ROWS = 500_000
_PAIRS = 1_000_000


def _edge_cells(edges: DataFrame, keys: Sequence[str], size: float, rows_per_task: int | None) -> DataFrame:
    """What the points of each grid square may meet on their right, per polygon.

    An edge matters to the squares from the polygon's left end to its own right end, on
    the rows it spans. Where it passes the whole height of the row to the right of the
    square, it is met by all points of the square alike; such edges are counted per polygon
    and square, and an odd number becomes one ``always`` row. The others stay edges.
    """
    left_end = edges.groupBy(*keys).agg(F.least(F.min("x1"), F.min("x2")).alias("_left"))
    sloped = edges.where(F.col("y1") != F.col("y2"))
    reach = skew_join(sloped, left_end, list(keys), "inner", rows_per_task)

    def cell(c):
        return F.floor(c / F.lit(size)).cast("int")

    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = reach.withColumn("_cy", F.explode(F.sequence(cell(low), cell(high))))
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    bottom, top = F.col("_cy") * F.lit(size), (F.col("_cy") + 1) * F.lit(size)
    x_low = F.col("x1") + (F.greatest(low, bottom) - F.col("y1")) * slope
    x_high = F.col("x1") + (F.least(high, top) - F.col("y1")) * slope
    rows = rows.withColumns(
        {
            "_min": F.least(x_low, x_high) - F.lit(_SLACK),
            "_max": F.greatest(x_low, x_high) + F.lit(_SLACK),
            "_whole": (low <= bottom) & (high >= top),
        }
    )
    laid = rows.withColumn("_cx", F.explode(F.sequence(cell(F.least("_left", "_max")), cell(F.col("_max")))))
    same_for_all = F.col("_whole") & (F.col("_min") >= (F.col("_cx") + 1) * F.lit(size))
    single = laid.where(~same_for_all).select(*keys, "_cx", "_cy", "x1", "y1", "x2", "y2", F.lit(False).alias("always"))
    none = [F.lit(None).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    shared = laid.where(same_for_all).groupBy(*keys, "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    shared = shared.where(F.col("_n") % 2 == 1).select(*keys, "_cx", "_cy", *none, F.lit(True).alias("always"))
    return single.unionByName(shared)


_POINT = ["flightid", "dt_radar", "lon", "lat", "bucket"]


def _in_squares(points: DataFrame, size: float) -> DataFrame:
    known = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    squares = {"_cx": F.floor(F.col("lon") / F.lit(size)), "_cy": F.floor(F.col("lat") / F.lit(size))}
    return known.withColumns({n: c.cast("int") for n, c in squares.items()})


def _polygon_cells(edges: DataFrame, keys: Sequence[str], size: float, rows_per_task: int | None) -> DataFrame:
    """One row per grid square and polygon: the edges to test, and whether those met by all points of the square are odd in number."""
    edge = F.when(~F.col("always"), F.struct("x1", "y1", "x2", "y2"))
    cells = _edge_cells(edges, ["bucket", *keys], size, rows_per_task)
    return cells.groupBy(*_CELL, *keys).agg(F.collect_list(edge).alias("edges"), F.max("always").alias("odd"))


#: Small squares a side that the points of a square are dealt to, at most, and the points that fill one, about.
FINE = 64
_FILL = 8
#: Places (polygon, small square) and edges that are looked at together.
_PLACES, _EDGES = 2_000_000, 20_000


def _mixed_bits(values: np.ndarray) -> np.ndarray:
    """64 bits per number with the lowest one clear, mixed so that different numbers do not cancel."""
    h = (values + 0.0).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) & ~np.uint64(1)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each position as often as its count says, and the number of each repetition from 0 on."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Places:
    """The points of a square, dealt to small squares: ``order`` sorts them, ``starts`` and ``counts`` tell where those of each small square are."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray):
        self.g = g = int(min(FINE, max(1, 2 ** math.ceil(math.log2(max(1.0, math.sqrt(len(lon) / _FILL)))))))
        self.left, self.right, self.low, self.high = lon.min(), lon.max(), lat.min(), lat.max()
        self.wide, self.tall = (self.right - self.left) / g or 1.0, (self.high - self.low) / g or 1.0
        at = self.row(lat) * g + self.col(lon)
        self.order = np.argsort(at, kind="stable")
        self.lon, self.lat = lon[self.order], lat[self.order]
        self.counts = np.bincount(at, minlength=g * g)
        self.starts = np.cumsum(self.counts) - self.counts
        rows = self.row(lat)
        self.least, self.most = np.full(g, np.inf), np.full(g, -np.inf)
        np.minimum.at(self.least, rows, lat)
        np.maximum.at(self.most, rows, lat)

    # Both grow with the value, so a lesser column or row means a lesser value.
    def col(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.left) / self.wide), 0, self.g - 1).astype(np.int64)

    def row(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((y - self.low) / self.tall), 0, self.g - 1).astype(np.int64)


def _laid_out(places: _Places, x1, y1, x2, y2):
    """The edges once per row of small squares: edge, row, first and last column that need a comparison, whether points before
    those columns meet the edge from the row's lower end on, the ends of the edge within the row as bits, and whether there are any.
    """
    g = places.g
    bad = ~np.isfinite(x1 + y1 + x2 + y2)
    lo, hi = np.where(bad, -np.inf, np.minimum(y1, y2)), np.where(bad, np.inf, np.maximum(y1, y2))
    first = np.where(lo <= places.low, -1, places.row(np.where(bad, 0.0, lo)))
    last = np.where(hi > places.high, g, places.row(np.where(bad, 0.0, hi)))
    meets = (lo <= places.high) & (hi > places.low)
    some = np.where(meets, np.minimum(last, g - 1) - np.maximum(first, 0) + 1, 0)
    edge, nth = _spread(some)
    row = np.maximum(first, 0)[edge] + nth
    e1, e2, f1, f2 = x1[edge], x2[edge], y1[edge], y2[edge]
    with np.errstate(all="ignore"):
        slope = (e2 - e1) / (f2 - f1)
        a = e1 + (np.maximum(lo[edge], places.least[row]) - f1) * slope
        b = e1 + (np.minimum(hi[edge], places.most[row]) - f1) * slope
        slack = _SLACK + 1e-12 * np.maximum(np.abs(e1), np.abs(e2))
        a, b = (np.clip(x, np.minimum(e1, e2), np.maximum(e1, e2)) for x in (a, b))
        xa, xb = np.minimum(a, b) - slack, np.maximum(a, b) + slack
    open_ = bad[edge] | ~np.isfinite(xa) | ~np.isfinite(xb)
    xa, xb = np.where(open_, -np.inf, xa), np.where(open_, np.inf, xb)
    west = np.where(xa > places.right, g, np.where(xa < places.left, 0, places.col(np.where(open_, 0.0, xa))))
    east = np.where(xb > places.right, g - 1, places.col(np.where(open_, 0.0, xb)))
    starts_in, ends_in = first[edge] == row, last[edge] == row
    bits = np.where(starts_in, _mixed_bits(lo)[edge], np.uint64(0)) ^ np.where(ends_in, _mixed_bits(hi)[edge], np.uint64(0))
    keep = (xb >= places.left) & (places.least[row] <= places.most[row])
    return tuple(c[keep] for c in (edge, row, west, east, ~starts_in, bits, starts_in | ends_in))


def _held(places: _Places, polygons: pa.Table, active: np.ndarray | None = None) -> Iterator[tuple]:
    """Which polygons hold which points of a square, some polygons at a time: ``first`` polygon, table (polygon, small square) that is true
    where all points are inside, and for single points polygons (counted from ``first``) and positions in ``places``.

    A polygon is settled for a small square that no edge of it comes near, if the ends of its edges to the right of the square cancel each other
    (those of a closed ring do); then one parity holds for all points there. In the other small squares points are
    compared with the edges that come near them, and with those to the right that end in their row. ``active`` tells, and may be changed
    to tell, in which small squares there is anything left to find.
    """
    g, n_cells = places.g, places.g**2
    lists = polygons["edges"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    flat = lists.flatten()
    x1, y1, x2, y2 = (np.asarray(flat.field(c)) for c in ("x1", "y1", "x2", "y2"))
    odd = polygons["odd"].to_numpy()
    ends = np.cumsum(sizes)
    first, most = 0, max(1, _PLACES // n_cells) if active is None else 16
    while first < len(sizes):
        if active is not None and not active.any():
            return
        before = ends[first] - sizes[first]
        upto = max(first + 1, min(first + most, int(np.searchsorted(ends, before + _EDGES, "right"))))
        most = min(2 * most, max(1, _PLACES // n_cells))
        there = slice(before, ends[upto - 1])
        c1, d1, c2, d2 = x1[there], y1[there], x2[there], y2[there]
        owner = np.repeat(np.arange(upto - first), sizes[first:upto])
        edge, row, west, east, below, bits, partial = _laid_out(places, c1, d1, c2, d2)
        poly = owner[edge]
        state = np.zeros((upto - first, g, g + 1), np.uint64)
        np.bitwise_xor.at(state.reshape(-1), (poly * g + row) * (g + 1) + west, bits ^ below.astype(np.uint64))
        state = np.bitwise_xor.accumulate(state[:, :, ::-1], axis=2)[:, :, ::-1][:, :, 1:].reshape(-1)
        inside = ((state & np.uint64(1)) != 0) ^ np.repeat(odd[first:upto], n_cells)
        unsettled = state > np.uint64(1)
        near, nth = _spread(np.maximum(east - west + 1, 0))
        near_at = (poly[near] * g + row[near]) * g + west[near] + nth
        unsettled[near_at] = True
        sought = places.counts > 0 if active is None else active
        unsettled &= np.tile(sought, upto - first)
        whole = (inside & ~unsettled).reshape(-1, n_cells) & (places.counts > 0)
        partial = np.flatnonzero(partial)
        before_, nth = _spread(np.minimum(west, g)[partial])
        before_ = partial[before_]
        before_at = (poly[before_] * g + row[before_]) * g + nth
        at = np.concatenate([near_at, before_at])
        which = np.concatenate([near, before_])
        flip = np.concatenate([np.zeros(len(near), bool), below[before_]])
        use = unsettled[at]
        if active is not None:
            use &= ~np.tile(whole.any(axis=0), upto - first)[at]
        yield first, whole, *_compared(places, at[use], edge[which[use]], flip[use], (c1, d1, c2, d2), inside, n_cells, unsettled, whole if active is not None else None)
        first = upto


def _compared(places: _Places, at, edge, flip, ends, inside, n_cells, unsettled, settled):
    """Polygons and positions of the points of unsettled places that are inside, by comparing each point with the edges given for its place."""
    if settled is not None:
        unsettled = unsettled & ~np.tile(settled.any(axis=0), len(unsettled) // n_cells)
    slots = np.flatnonzero(unsettled)
    cells = slots % n_cells
    count = places.counts[cells]
    bound = np.cumsum(count)
    slot = np.searchsorted(slots, at)
    if len(bound) and bound[-1] > _PAIRS:
        sort = np.argsort(slot, kind="stable")
        slot, edge, flip = slot[sort], edge[sort], flip[sort]
        cuts = [0]
        while cuts[-1] < len(slots):
            done = bound[cuts[-1]] - count[cuts[-1]]
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(bound, done + _PAIRS, "right"))))
        groups = [(a, b, slice(*np.searchsorted(slot, (a, b)))) for a, b in zip(cuts, cuts[1:])]
    else:
        groups = [(0, len(slots), slice(0, len(slot)))]
    x1, y1, x2, y2 = ends
    polys, found = [], []
    for a, b, part in groups:
        size = count[a:b]
        offset = np.cumsum(size) - size
        odd = np.repeat(inside[slots[a:b]], size)
        s, e, f = slot[part] - a, edge[part], flip[part]
        upto = np.cumsum(size[s])
        done = 0
        while done < len(s):
            some = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + _PAIRS, "right")))
            t, k, turned = s[done:some], e[done:some], f[done:some]
            n = size[t]
            which, nth = _spread(n)
            point = np.repeat(places.starts[cells[a:b][t]], n) + nth
            px, py = places.lon[point], places.lat[point]
            b1, b2 = np.repeat(y1[k], n), np.repeat(y2[k], n)
            crossed = (b1 > py) != (b2 > py)
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed &= px < np.repeat(x2[k] - x1[k], n) * (py - b1) / np.repeat(y2[k] - y1[k], n) + np.repeat(x1[k], n)
            crossed ^= np.repeat(turned, n)
            target = (np.repeat(offset[t], n) + nth)[crossed]
            odd ^= (np.bincount(target, minlength=len(odd)) & 1).astype(bool)
            done = some
        hit = np.flatnonzero(odd)
        owner = np.searchsorted(offset, hit, "right") - 1
        polys.append(slots[a:b][owner] // n_cells)
        found.append(places.starts[cells[a:b][owner]] + hit - offset[owner])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *polys]), np.concatenate([none, *found])


def _dealt(points: pa.Table) -> tuple[_Places | None, np.ndarray]:
    """The points with finite positions in small squares, and which ones of all they are; other points are in no polygon."""
    lon, lat = (points[c].to_numpy() for c in ("lon", "lat"))
    finite = np.flatnonzero(np.isfinite(lon) & np.isfinite(lat))
    if not len(finite):
        return None, finite
    places = _Places(lon[finite], lat[finite])
    return places, finite[places.order]


def _per_square(points: DataFrame, edges: DataFrame, keys: Sequence[str], size: float, rows_per_task: int | None, solve, schema) -> DataFrame:
    """``solve`` applied to the distinct points of a square, with ``copies``, and the polygons it may meet.

    The points are shuffled once, by square (crowded squares to several tasks); copies are counted and polygons met where that puts them,
    so no row per crossing, nor per point and polygon, is written anywhere.
    """
    limit = rows_per_task or SQUARE_ROWS
    squares = _in_squares(points.select(_POINT), size)
    cells = _polygon_cells(edges, keys, size, rows_per_task)
    hot, at = hot_keys(squares, _CELL, limit), [*_CELL]
    if hot is not None:  # a constant slice would hide from the planner that all steps go by the same square
        squares, cells = deal(squares, cells, _CELL, hot, limit)
        at.append("_slice")
    once = squares.repartition(*at).groupBy("_cx", "_cy", *at[3:], *_POINT).agg(F.count(F.lit(1)).alias("copies"))
    return once.groupBy(*at).cogroup(cells.groupBy(*at)).applyInArrow(solve, schema)


def containments(
    points: DataFrame, edges: DataFrame, keys: Sequence[str], size: float, rows_per_task: int | None = None, per_point: bool = True
) -> DataFrame:
    """(point, copies, polygon keys) for each polygon of the same bucket that holds the point.

    ``points``: flightid, dt_radar, lon, lat, bucket; equal points are counted as copies.
    ``edges``: bucket, the keys, vertice, x1, y1, x2, y2. An odd number of crossed edges
    means inside. Without ``per_point`` only (bucket, polygon keys, points), the sum of copies per square and polygon.
    """
    polygon = ["bucket", *keys]
    kinds = [edges.schema[c] for c in polygon]

    def pairs(here: pa.Table, polygons: pa.Table) -> pa.Table:
        point, poly = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        places, of = _dealt(here)
        for first, whole, polys, found in _held(places, polygons) if places else ():
            q, cell = np.nonzero(whole)
            which, nth = _spread(places.counts[cell])
            point += [of[places.starts[cell][which] + nth], of[found]]
            poly += [first + q[which], first + polys]
        point, poly = np.concatenate(point), np.concatenate(poly)
        columns = [*(here[c].take(point) for c in (*_POINT, "copies")), *(polygons[k].take(poly) for k in keys)]
        return pa.table(columns, names=[*_POINT, "copies", *keys])

    def numbers(here: pa.Table, polygons: pa.Table) -> pa.Table:
        total = np.zeros(polygons.num_rows, np.int64)
        places, of = _dealt(here)
        if places:
            copies = here["copies"].to_numpy()[of]
            sums = np.diff(np.append(0, np.cumsum(copies))[np.append(places.starts, len(copies))])
        for first, whole, polys, found in _held(places, polygons) if places else ():
            total[first : first + len(whole)] += whole @ sums
            np.add.at(total, first + polys, copies[found])
        hit = np.nonzero(total)[0]
        return pa.table([*(polygons[c].take(hit) for c in polygon), pa.array(total[hit])], names=[*polygon, "points"])

    if not per_point:
        return _per_square(points, edges, keys, size, rows_per_task, numbers, StructType([*kinds, StructField("points", LongType())]))
    schema = StructType([*(points.schema[c] for c in _POINT), StructField("copies", LongType()), *kinds[1:]])
    return _per_square(points, edges, keys, size, rows_per_task, pairs, schema)


def mark_inside(
    points: DataFrame, vertices: DataFrame, keys: Sequence[str] = ("poly",), size: float = 2.5, rows_per_task: int | None = None
) -> DataFrame:
    """Points ``(flightid, dt_radar, lon, lat, bucket)`` with ``copies`` and ``inside`` (0/1, any polygon).

    ``vertices``: bucket, keys, vertice, x (longitude), y (latitude).
    """

    def solve(here: pa.Table, polygons: pa.Table) -> pa.Table:
        inside = np.zeros(here.num_rows, np.int32)
        places, of = _dealt(here)
        if places:
            held = np.zeros(len(of), bool)
            active = places.counts > 0
            for _, whole, _, found in _held(places, polygons, active):
                full = whole.any(axis=0)
                held[found] = True
                held |= np.repeat(full, places.counts)
                active &= np.add.reduceat(np.append(~held, False), places.starts) > 0
            inside[of] = held
        marked = here.select([*_POINT, "copies"])
        return marked.append_column("inside", pa.array(inside))

    edges = ring_edges(vertices, ["bucket", *keys])
    schema = StructType([points.schema[c] for c in _POINT])
    schema = schema.add("copies", LongType()).add("inside", IntegerType())
    placed = _per_square(points, edges, keys, size, rows_per_task, solve, schema)
    nowhere = points.where("lon IS NULL OR lat IS NULL").groupBy(*_POINT).agg(F.count(F.lit(1)).alias("copies"), F.lit(0).alias("inside"))
    return placed.unionByName(nowhere)


def hits_per_flight(marked: DataFrame) -> DataFrame:
    return marked.groupBy("flightid").agg(
        F.sum(F.col("inside") * F.col("copies")).alias("inside"), F.sum("copies").alias("points")
    )


def polygons_hit(
    points: DataFrame, vertices: DataFrame, keys: Sequence[str] = ("poly",), size: float = 2.5, rows_per_task: int | None = None
) -> DataFrame:
    """Each polygon with the number of points in it and a 0/1 hit flag."""
    edges = ring_edges(vertices, ["bucket", *keys])
    found = containments(points, edges, keys, size, rows_per_task, per_point=False)
    both = edges.select("bucket", *keys, F.lit(0).cast("long").alias("points")).unionByName(found)
    return both.groupBy("bucket", *keys).agg(F.sum("points").alias("points")).withColumn(
        "hit", F.when(F.col("points") > 0, 1).otherwise(0)
    )


def most_exposed(marked: DataFrame) -> DataFrame:
    """The flight with most points inside; with none inside anywhere, the one with most points."""
    return hits_per_flight(marked).orderBy(F.desc("inside"), F.desc("points"), "flightid").limit(1)


def _points_of(points: DataFrame, flight: DataFrame) -> DataFrame:
    """The points of the flight in a table of one row; the row goes to the tasks, not to the driver."""
    return points.join(F.broadcast(flight.select("flightid").limit(1)), "flightid", "left_semi")


def overlay_polygons(
    points: DataFrame, vertices: DataFrame, flight: DataFrame, keys: Sequence[str] = ("poly",), size: float = 2.5
) -> DataFrame:
    """The polygons that hold points of one flight (the first row of ``flight``), with the number of these points."""
    found = containments(_points_of(points, flight), ring_edges(vertices, ["bucket", *keys]), keys, size, per_point=False)
    return found.groupBy("bucket", *keys).agg(F.sum("points").alias("points"))


def overlay(points: DataFrame, vertices: DataFrame, flight: DataFrame, size: float = 2.5) -> DataFrame:
    """Points of one flight (the first row of ``flight``) in time order, with inside flag and start/end marks."""
    own = cut_lineage(mark_inside(_points_of(points, flight), vertices, size=size))
    # One row: there is one flight.
    ends = own.groupBy("flightid").agg(F.min("dt_radar").alias("_first"), F.max("dt_radar").alias("_last"))
    return own.join(F.broadcast(ends), "flightid").select(
        "flightid", "dt_radar", "lon", "lat", "bucket", "inside",
        (F.col("dt_radar") == F.col("_first")).cast("int").alias("is_start"),
        (F.col("dt_radar") == F.col("_last")).cast("int").alias("is_end"),
    ).orderBy("dt_radar")
