"""Feature tables for training and scoring. One function adds the features to both."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.text import drop_prefix, image_time, route_key
from ..operators import calendars, encode, flights, tracks, weather
from ..operators.joins import attach
from ..session import cut_lineage
from ..sources.schemas import FEATURES

# Column names of the three calendar profiles in the feature table.
HOLDING_NAMES = {
    "hour": {"mean": "mean_x", "sum": "sum_x"},
    "weekday": {"mean": "mean_y", "sum": "sum_y"},
    "airport": {},
}
PREDICTED_NAMES = {
    "hour": {"troca_prev_mean": "troca_prev_mean_x", "troca_prev_sum": "troca_prev_sum_x"},
    "weekday": {"troca_prev_mean": "troca_prev_mean_y", "troca_prev_sum": "troca_prev_sum_y"},
    "airport": {},
}
ACTUAL_NAMES = {"hour": {"troca_real": "troca_real_x"}, "weekday": {"troca_real": "troca_real_y"}, "airport": {}}
# Names of the route history columns in the feature table.
HISTORY_NAMES = {
    "n_flights": "flightid_",
    "duration_mean": "dt_radar_lambda",
    "duration_min": "dt_radar_lambda1",
    "duration_max": "dt_radar_lambda2",
    "duration_std": "dt_radar_lambda3",
    "distancia": "distancia_",
}


@dataclass
class Tables:
    """What the feature step needs besides the flights; all unique on their join key."""

    holdings: DataFrame
    holding_profiles: dict[str, DataFrame]
    weather_x: DataFrame
    weather_y: DataFrame
    predicted: DataFrame
    predicted_profiles: dict[str, DataFrame]
    actual: DataFrame
    actual_profiles: dict[str, DataFrame]
    history: DataFrame
    exposure: DataFrame


def flight_table(raw: DataFrame) -> DataFrame:
    """The prepared flights, written once because every branch of the features reads them."""
    return cut_lineage(flights.prepare_flights(raw))


def build_tables(
    prepared: DataFrame,
    points: DataFrame,
    holdings: DataFrame,
    observed: DataFrame,
    forecast: DataFrame,
    predicted: DataFrame,
    actual: DataFrame,
    exposure: DataFrame,
) -> Tables:
    """Aggregate every source once. ``points`` in radians, times in epoch milliseconds.

    Weather, history and exposure are written, since training and scoring read them both.
    """
    held, pred, real = (calendars.with_calendar(t) for t in (holdings, predicted, actual))
    summary = tracks.with_route(tracks.track_summary(tracks.degrees_of(points)), prepared)
    return Tables(
        holdings=held,
        holding_profiles=calendars.profiles(held, calendars.mean_and_sum("esperas")),
        weather_x=cut_lineage(weather.hourly_weather(weather.parse_reports(observed, "metar"))),
        weather_y=cut_lineage(weather.hourly_weather(weather.parse_reports(forecast, "metaf"))),
        predicted=pred,
        predicted_profiles=calendars.profiles(pred, calendars.mean_and_sum("troca", "troca_prev_mean", "troca_prev_sum")),
        actual=real,
        actual_profiles=calendars.profiles(real, calendars.count_of("aero")),
        history=cut_lineage(tracks.route_history(summary).withColumnsRenamed(HISTORY_NAMES)),
        exposure=cut_lineage(exposure),
    )


def add_features(rows: DataFrame, tables: Tables) -> DataFrame:
    """Left joins to unique tables only, so the number of rows stays the same.

    ``rows`` carries origem, destino, linha, diaSemana, hora, dep_hour and report_hour.
    """
    out = calendars.bucket_sum(rows, tables.holdings, "esperas", "esperas")
    out = calendars.attach_profiles(out, tables.holding_profiles, "origem", HOLDING_NAMES)
    out = weather.attach_blocks(out, [(tables.weather_x, "destino", "report_hour", "_x"), (tables.weather_y, "destino", "report_hour", "_y")])
    out = calendars.bucket_sum(out, tables.predicted, "troca", "troca")
    out = calendars.bucket_count(out, tables.actual, "trocareal", at_least=1)
    out = out.withColumn("_short", drop_prefix(F.col("origem"), 2))
    out = calendars.attach_profiles(out, tables.predicted_profiles, "_short", PREDICTED_NAMES)
    out = calendars.attach_profiles(out, tables.actual_profiles, "_short", ACTUAL_NAMES).drop("_short")
    out = attach(out, tables.history, ["linha"])
    return attach(out, tables.exposure, ["flightid"])


def dictionaries(prepared: DataFrame) -> dict[str, DataFrame]:
    """Codes of airports and routes in order of the first flight that shows them."""
    columns = ("origem", "destino", "linha")
    codes = cut_lineage(encode.label_dictionaries(prepared, columns, "flightid"))
    return {c: codes.where(F.col("column") == c).select("value", "code") for c in columns}


def _coded(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    for column, table in codes.items():
        df = encode.encode(df, column, table)
    return df


def training_table(
    prepared: DataFrame, tables: Tables, codes: dict[str, DataFrame] | None = None, longer_than: int | None = None
) -> DataFrame:
    """flightid, target and the contract's features. ``longer_than`` keeps flights with a larger target."""
    rows = prepared.withColumn("report_hour", F.col("arr_hour"))
    if longer_than is not None:
        rows = rows.where(F.col("target") > longer_than)
    out = add_features(rows, tables)
    if codes:
        out = _coded(out, codes)
    return out.select("flightid", "target", *[F.col(f"`{c}`") for c in FEATURES])


def scoring_rows(test_set: DataFrame) -> DataFrame:
    """Rows to score: hour and weekday come from the image the row refers to."""
    at = image_time(F.col("path"))
    return test_set.select(
        "flightid",
        "origem",
        "destino",
        route_key(F.col("origem"), F.col("destino")).alias("linha"),
        times.weekday(at).alias("diaSemana"),
        times.hour_of_day(at).alias("hora"),
        times.hour_bucket(at).alias("dep_hour"),
        times.hour_bucket(at).alias("report_hour"),
    )


def scoring_table(test_set: DataFrame, tables: Tables, codes: dict[str, DataFrame] | None = None) -> DataFrame:
    """flightid and the same features in the same order as for training."""
    out = add_features(scoring_rows(test_set), tables)
    if codes:
        out = _coded(out, codes)
    return out.select("flightid", *[F.col(f"`{c}`") for c in FEATURES])
