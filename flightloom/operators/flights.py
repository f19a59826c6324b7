"""Movements: one row per flight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import route_key
from .clean import first_per_key


def prepare_flights(raw: DataFrame) -> DataFrame:
    """Times, duration target, route, hour and weekday of departure; one row per flight.

    A flight listed twice keeps the row that departs (then arrives) first.
    """
    once = first_per_key(raw, ["flightid"], ["dt_dep", "dt_arr", "origem", "destino"])
    dep, arr = times.from_epoch_ms(F.col("dt_dep")), times.from_epoch_ms(F.col("dt_arr"))
    return once.select(
        "flightid",
        "origem",
        "destino",
        dep.alias("dt_dep"),
        arr.alias("dt_arr"),
        times.whole_seconds(dep, arr).alias("target"),
        route_key(F.col("origem"), F.col("destino")).alias("linha"),
        times.weekday(dep).alias("diaSemana"),
        times.hour_of_day(dep).alias("hora"),
        times.hour_bucket(dep).alias("dep_hour"),
        times.hour_bucket(arr).alias("arr_hour"),
    )
