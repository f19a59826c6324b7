"""Tracks for flights that have none yet: the route's most typical flight, thinned and moved in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tracks
from ..operators.joins import keep_members
from ..operators.skew import hot_keys
from ..session import cut_lineage


def representative_tracks(points: DataFrame, flights: DataFrame, every: int = 7) -> DataFrame:
    """Every n-th point of the most typical flight of each route, with the route."""
    times = tracks.time_span(points).join(flights.select("flightid", "linha"), "flightid")
    chosen = cut_lineage(tracks.typical_flight(times.select("linha", "flightid", "flight_time")))
    # Very long tracks are looked for once, among all points.
    hot = hot_keys(points, ["flightid"])
    kept = keep_members(points, chosen, ["flightid"], hot=hot)
    return tracks.every_nth(kept, every, hot=hot).join(chosen, "flightid")


def synthetic_tracks(representatives: DataFrame, new_flights: DataFrame) -> DataFrame:
    """Each new flight (flightid, linha, dt_dep in ms) with its route's track, starting at its departure.

    A flight whose route has no representative keeps one row without positions.
    """
    starts = representatives.groupBy("linha").agg(F.min("dt_radar").alias("_start"))
    moved = new_flights.join(starts, "linha", "left").withColumn("_shift", F.col("dt_dep") - F.col("_start"))
    spread = tracks.spread_to_flights(moved.drop("_start"), representatives.drop("dt_dep"))
    return spread.withColumn("dt_radar", F.col("dt_radar") + F.col("_shift")).drop("_shift")
