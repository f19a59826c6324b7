"""Weather reports: parsing, hourly statistics, and their join to flights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.reports import NUMERIC_FIELDS, add_report_columns
from .clean import several
from .joins import attach

STATISTICS = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def parse_reports(reports: DataFrame, text: str) -> DataFrame:
    """Add the report fields."""
    return add_report_columns(reports, text)


def parse_rate(parsed: DataFrame) -> DataFrame:
    """How many reports had a readable header."""
    return parsed.agg(
        F.count(F.lit(1)).alias("reports"),
        F.count_if("parse_ok").alias("parsed"),
        F.avg(F.col("parse_ok").cast("int")).alias("rate"),
    )


def hourly_weather(parsed: DataFrame, time_ms: str = "hora", airport: str = "aero", fill: float | None = None) -> DataFrame:
    """Mean, min, max and standard deviation of the six measures per airport and hour.

    Flights are unique, so statistics per (airport, hour) equal statistics per flight after
    the join; aggregating first keeps the join one to one.
    """
    rows = parsed.fillna(fill, subset=NUMERIC_FIELDS) if fill is not None else parsed
    hour = times.hour_bucket(times.from_epoch_ms(F.col(time_ms))).alias("hour_ts")
    rows = rows.select(F.col(airport).alias("aero"), hour, *[F.col(f"`{c}`") for c in NUMERIC_FIELDS])
    known = rows.where(F.col("aero").isNotNull())
    return known.groupBy("aero", "hour_ts").agg(*several(NUMERIC_FIELDS, STATISTICS, sep=""))


def attach_weather(flights: DataFrame, hourly: DataFrame, airport: str, hour: str, suffix: str) -> DataFrame:
    """Add the 24 statistics of the report hour at the given airport, names ending in suffix."""
    return attach_blocks(flights, [(hourly, airport, hour, suffix)])


def attach_blocks(flights: DataFrame, blocks: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """``attach_weather`` for each (hourly, airport, hour, suffix).

    A block goes through the joins as one column, so that the wide rows are made once, after the last join.
    """
    out, cells, taken = flights, [], set(flights.columns)
    for i, (hourly, airport, hour, suffix) in enumerate(blocks):
        measured = [c for c in hourly.columns if c not in ("aero", "hour_ts")]
        side = hourly.select("aero", "hour_ts", F.struct(*[F.col(f"`{c}`") for c in measured]).alias(f"_block{i}"))
        out = attach(out, side, [airport, hour], ["aero", "hour_ts"])
        names = {c: c + suffix + ("_y" if c + suffix in taken else "") for c in measured}
        cells += [F.col(f"_block{i}").getField(c).alias(n) for c, n in names.items()]
        taken |= set(names.values())
    return out.select(*[F.col(f"`{c}`") for c in flights.columns], *cells)


def first_report(reports: DataFrame, keys: Sequence[str], text: str, order: Sequence[str]) -> DataFrame:
    """First non-null report per key in the given order."""
    known = reports.where(F.col(text).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(F.min_by(text, F.struct(*order)).alias(text))
