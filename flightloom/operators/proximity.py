"""Polygons of one picture that come within a few pixels of each other, merged to convex hulls."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .skew import hot_keys, skew_join

# Squares are numbered by row and column, each within ±_OFFSET, in one negative long.
_OFFSET = 1 << 30

#: Squares along a side of a tile, which one task solves; a usual picture lies in one tile.
TILE = 256

# Fixed value: vertices this many pixels apart or less join their polygons.
REACH = 20


def _pixels(vertices: DataFrame) -> DataFrame:
    """Distinct integer pixels of each picture."""
    return vertices.select("image", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()


def _links(vertices: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """(image, poly, square): the squares of each polygon. (image, a, b): squares that are near each other.

    Any two pixels of one small square are within reach, so a polygon belongs to the squares it has vertices in, and no pairs inside
    a square are needed. Two squares are near if some pixel of one is within reach of some pixel of the
    other; a square has at most side² distinct pixels however many vertices lie on them.
    """
    side = max(1, int(reach / math.sqrt(2)) + 1)
    while side > 1 and math.hypot(side - 1, side - 1) > reach:
        side -= 1

    def cell(c):
        return F.floor(F.col(c) / F.lit(float(side)))

    def square(i, j):
        return -1 - ((i + _OFFSET) * (2 * _OFFSET) + (j + _OFFSET))

    own = vertices.select("image", F.col("poly").cast("long").alias("poly"), square(cell("x"), cell("y")).alias("square")).distinct()
    pixels = _pixels(vertices).withColumns({"ci": cell("x"), "cj": cell("y")})
    ring = math.ceil(reach / side)
    forward = [
        F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"))
        for i in range(0, ring + 1)
        for j in range(-ring, ring + 1)
        if (i, j) > (0, 0)
    ]
    looking = pixels.select("image", "x", "y", "ci", "cj", F.explode(F.array(*forward)).alias("_d")).select(
        "image", "x", "y", F.col("ci").alias("fi"), F.col("cj").alias("fj"),
        (F.col("ci") + F.col("_d.di")).alias("ci"), (F.col("cj") + F.col("_d.dj")).alias("cj"),
    )
    other = pixels.withColumnsRenamed({"x": "ox", "y": "oy"})
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    near = looking.join(other, ["image", "ci", "cj"]).where(dx * dx + dy * dy <= reach * reach)
    across = near.select("image", square(F.col("fi"), F.col("fj")).alias("a"), square(F.col("ci"), F.col("cj")).alias("b"))
    return own, across.distinct()


def _tile(square: str) -> list:
    """Row and column of the tile of a square."""
    number = -1 - F.col(square)
    row = F.floor(number / F.lit(2 * _OFFSET)) - _OFFSET
    return [F.floor(row / TILE).cast("long"), F.floor((F.pmod(number, F.lit(2 * _OFFSET)) - _OFFSET) / TILE).cast("long")]


def _united(kind: pa.DataType):
    """Smallest square of each component within a tile; rows are sorted by tile, and only one tile's squares are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parent = None, {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        def done() -> pa.RecordBatch:
            nodes = list(parent)
            columns = [pa.array([at[0]] * len(nodes), kind), pa.array(nodes, pa.int64()), pa.array(list(map(top, nodes)), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["image", "node", "root"])

        for batch in batches:
            for *tile, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != at:
                    if at is not None:
                        yield done()
                    at, parent = tile, {}
                a, b = top(a), top(b)
                parent[max(a, b)] = min(a, b)
        if at is not None:
            yield done()

    return run


def _square_labels(edges: DataFrame, rows_per_task: int | None) -> DataFrame:
    """(image, node, label) of all squares in ``edges``: each tile is solved in one task, and rounds of joins run only on what crosses tiles."""
    tiled = cut_lineage(edges.select("image", "a", "b", (_tile("a")[0] == _tile("b")[0]).alias("_rows"), (_tile("a")[1] == _tile("b")[1]).alias("_cols")))
    inside = tiled.where("_rows AND _cols").select("image", _tile("a")[0].alias("ti"), _tile("a")[1].alias("tj"), "a", "b")
    inside = inside.repartition("image", "ti", "tj").sortWithinPartitions("image", "ti", "tj")
    kind = edges.schema["image"].dataType
    local = cut_lineage(inside.mapInArrow(_united(to_arrow_type(kind)), f"image {kind.simpleString()}, node long, root long"))
    crossing = tiled.where("NOT (_rows AND _cols)").select("image", "a", "b")
    for end in ("a", "b"):
        roots = local.select("image", F.col("node").alias(end), F.col("root").alias("_root"))
        crossing = crossing.join(roots, ["image", end], "left").withColumn(end, F.coalesce("_root", end)).drop("_root")
    crossing = cut_lineage(crossing.distinct())
    if crossing.isEmpty():
        return local.withColumnRenamed("root", "label")
    upper = connected_labels(crossing, rows_per_task).select("image", F.col("node").alias("root"), F.col("label").alias("_label"))
    every = local.unionByName(upper.select("image", F.col("root").alias("node"), "root")).distinct()
    return every.join(upper, ["image", "root"], "left").select("image", "node", F.coalesce("_label", "root").alias("label"))


def connected_labels(links: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """(image, node, label): the smallest node of each connected component.

    Each node keeps a parent. In a round every node takes its parent's parent; where a link
    shows a smaller one on the other side, both the node and its parent take that. Trees
    hook onto each other and flatten, so few rounds are needed even for long chains. Each
    round ends in a written table; hot nodes and hot parents are split in the joins.
    """
    both = links.unionByName(links.select("image", F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.withColumnRenamed("a", "node"))
    crowded = hot_keys(both, ["image", "node"], rows_per_task)
    labels = both.groupBy("image", "node").agg(F.min("b").alias("label"))
    labels = cut_lineage(labels.withColumn("label", F.least("label", "node")))
    while True:
        above = labels.select("image", F.col("node").alias("label"), F.col("label").alias("top"))
        tops = skew_join(labels.select("image", "node", "label"), above, ["image", "label"], "inner", rows_per_task)
        this = skew_join(both, tops.select("image", "node", "top"), ["image", "node"], "inner", rows_per_task, hot=crowded)
        other = this.select("image", F.col("b").alias("node"), F.col("top").alias("seen"))
        pairs = skew_join(other, tops, ["image", "node"], "inner", rows_per_task, hot=crowded).where("seen < top")
        unknown = F.lit(None).cast("long").alias("old")
        offers = (
            tops.select("image", "node", F.col("top").alias("label"), F.col("label").alias("old"))
            .unionByName(pairs.select("image", "node", F.col("seen").alias("label"), unknown))
            .unionByName(pairs.select("image", F.col("label").alias("node"), F.col("seen").alias("label"), unknown))
        )
        labels = cut_lineage(offers.groupBy("image", "node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        if labels.where(F.col("label") < F.col("old")).isEmpty():
            return labels.drop("old")


def proximity_components(vertices: DataFrame, reach: int = REACH, rows_per_task: int | None = None) -> DataFrame:
    """(image, poly, component): component is the smallest polygon number in it."""
    own, near = _links(vertices, reach)
    own = cut_lineage(own)
    anchors = cut_lineage(own.groupBy("image", "poly").agg(F.min("square").alias("a")))
    spread = own.join(anchors, ["image", "poly"]).select("image", "a", F.col("square").alias("b")).distinct()
    labels = _square_labels(spread.unionByName(near), rows_per_task).withColumnRenamed("node", "a")
    polys = skew_join(anchors, labels, ["image", "a"], "inner", rows_per_task).select("image", "poly", "label")
    smallest = polys.groupBy("image", "label").agg(F.min("poly").alias("component"))
    return skew_join(polys, smallest, ["image", "label"], "inner", rows_per_task).select("image", "poly", "component")


def _turn(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _half(points: Iterator) -> list:
    out: list = []
    for p in points:
        while len(out) >= 2 and _turn(out[-2], out[-1], p) <= 0:
            out.pop()
        out.append(p)
    return out


def convex_ring(points) -> list[tuple]:
    """Corners of the convex hull, counter-clockwise from the leftmost."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    return _half(points)[:-1] + _half(reversed(points))[:-1]


def _hull(frame: pd.DataFrame) -> pd.DataFrame:
    ends = [(int(x), int(y)) for column in ("low", "high") for x, y in zip(frame["x"], frame[column])]
    corners = convex_ring(ends)
    return pd.DataFrame(
        {
            "image": frame["image"].iloc[0],
            "component": frame["component"].iloc[0],
            "vertice": range(len(corners)),
            "x": [c[0] for c in corners],
            "y": [c[1] for c in corners],
        }
    )


def proximity_hulls(vertices: DataFrame, components: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Hull vertices of each component.

    Only the lowest and highest pixel of a picture column can be a hull corner, so each
    component comes down to two pixels per column in plain aggregation; what reaches the
    hull function is at most the width of the picture.
    """
    placed = skew_join(vertices, components, ["image", "poly"], "inner", rows_per_task)
    extremes = placed.groupBy("image", "component", F.col("x").cast("long").alias("x")).agg(
        F.min("y").cast("long").alias("low"), F.max("y").cast("long").alias("high")
    )
    kind = extremes.schema["image"].dataType.simpleString()
    return extremes.groupBy("image", "component").applyInPandas(
        _hull, f"image {kind}, component long, vertice int, x long, y long"
    )
