"""Hourly airport tables (holdings, runway changes) and their features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from .joins import attach


def with_calendar(rows: DataFrame, time_ms: str = "hora") -> DataFrame:
    """Replace an epoch column by hour bucket, hour of day and weekday."""
    ts = times.from_epoch_ms(F.col(time_ms))
    return rows.withColumn("_ts", ts).withColumns(
        {
            "hour_ts": times.hour_bucket(F.col("_ts")),
            "diaSemana": times.weekday(F.col("_ts")),
            "hora": times.hour_of_day(F.col("_ts")),
        }
    ).drop("_ts")


def mean_and_sum(column: str, mean: str = "mean", total: str = "sum") -> dict[str, Column]:
    return {mean: F.avg(column), total: F.coalesce(F.sum(column), F.lit(0.0))}


def count_of(column: str, name: str = "troca_real") -> dict[str, Column]:
    return {name: F.count(column)}


def profile_by(rows: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    known = rows
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def profiles(rows: DataFrame, measures: Mapping[str, Column], airport: str = "aero") -> dict[str, DataFrame]:
    """The three calendar profiles: airport and hour, airport and weekday, airport."""
    return {
        "hour": profile_by(rows, [airport, "hora"], measures),
        "weekday": profile_by(rows, [airport, "diaSemana"], measures),
        "airport": profile_by(rows, [airport], measures),
    }


def profile_sets(rows: DataFrame, measures: Mapping[str, Column], airport: str = "aero") -> DataFrame:
    """All three profiles from one scan; ``level`` says which keys a row is grouped by."""
    known = rows.where(F.col(airport).isNotNull())
    return known.groupingSets(
        [[F.col(airport), F.col("hora")], [F.col(airport), F.col("diaSemana")], [F.col(airport)]],
        F.col(airport),
        F.col("hora"),
        F.col("diaSemana"),
    ).agg(
        F.when(F.grouping("hora") == 0, "hour")
        .when(F.grouping("diaSemana") == 0, "weekday")
        .otherwise("airport")
        .alias("level"),
        *[c.alias(n) for n, c in measures.items()],
    )


def attach_profiles(
    flights: DataFrame,
    tables: Mapping[str, DataFrame],
    airport: str,
    names: Mapping[str, Mapping[str, str]],
) -> DataFrame:
    """Join the three profiles to flights; ``names`` gives each profile's output columns."""
    keys = {"hour": [airport, "hora"], "weekday": [airport, "diaSemana"], "airport": [airport]}
    table_keys = {"hour": ["aero", "hora"], "weekday": ["aero", "diaSemana"], "airport": ["aero"]}
    for level, table in tables.items():
        flights = attach(flights, table.withColumnsRenamed(dict(names[level])), keys[level], table_keys[level])
    return flights


def bucket_sum(
    flights: DataFrame,
    rows: DataFrame,
    value: str,
    name: str,
    flight_keys: Sequence[str] = ("dep_hour",),
    row_keys: Sequence[str] = ("hour_ts",),
) -> DataFrame:
    """Sum of a value over all rows of the flight's hour, 0 when there are none.

    The rows are summed per bucket first, so the join is one to one instead of flights
    times rows of the hour.
    """
    sums = rows.groupBy(*row_keys).agg(F.sum(value).alias(name))
    return attach(flights, sums, list(flight_keys), list(row_keys)).withColumn(name, F.coalesce(name, F.lit(0.0)))


def bucket_count(
    flights: DataFrame,
    rows: DataFrame,
    name: str,
    flight_keys: Sequence[str] = ("dep_hour",),
    row_keys: Sequence[str] = ("hour_ts",),
    at_least: int = 0,
) -> DataFrame:
    """Number of rows in the flight's hour. ``at_least=1`` counts a flight without a match as 1."""
    counts = rows.groupBy(*row_keys).agg(F.count(F.lit(1)).alias(name))
    found = F.greatest(F.coalesce(name, F.lit(0)), F.lit(at_least)).cast("long")
    return attach(flights, counts, list(flight_keys), list(row_keys)).withColumn(name, found)
