"""Queries on coded weather reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reports import NUMERIC_FIELDS, TEXT_FIELDS
from ..operators import weather
from . import standins as s
from .registry import Registry
from .standins import q, r, rounded, sql
from .tracks import movements

REGISTRY = Registry()
_add = REGISTRY.add

# The report fields in the other engine's pattern language.
_OK = "regexp_matches(t, '^(METAR|SPECI) (COR )?[A-Z][A-Z0-9]{3} [0-9]{6}Z ')"
_SKY = "((FEW|SCT|BKN|OVC|VV)[0-9]{3}(CB|TCU)?|SKC|CLR|NSC|NCD)"
_WX = (
    "((-|\\+|VC)?(MI|PR|BC|DR|BL|SH|TS|FZ)?"
    "((DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PY|PO|SQ|FC|SS|DS)+|TS|SH))"
)


def _celsius(group: int) -> str:
    code = f"nullif(regexp_extract(t, ' (M?[0-9]{{2}})/(M?[0-9]{{2}})?([ =]|$)', {group}), '')"
    return f"CASE WHEN {code} LIKE 'M%' THEN -CAST(substr({code}, 2) AS DOUBLE) ELSE TRY_CAST({code} AS DOUBLE) END"


def _wind(group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract(t, ' ([0-9]{{3}}|VRB)([0-9]{{2,3}})(G[0-9]{{2,3}})?(KT|MPS|KMH) ', {group}), '') AS DOUBLE)"


_METRES = "TRY_CAST(nullif(regexp_extract(t, ' ([0-9]{4})([NSEW]{1,2}|NDV)?([ =]|$)', 1), '') AS DOUBLE)"
_PART = "TRY_CAST(nullif(regexp_extract(t, ' ([0-9])/([0-9]{1,2})SM', %d), '') AS DOUBLE)"
_WHOLE = "TRY_CAST(nullif(regexp_extract(t, ' ([0-9]{1,2})( [0-9]/[0-9]{1,2})?SM', 1), '') AS DOUBLE)"
_MILES = f"CASE WHEN t LIKE '%SM %' THEN round((coalesce({_WHOLE}, 0) + coalesce({_PART % 1} / {_PART % 2}, 0)) * 1609.344::DOUBLE, 1) END"
_FIELDS = {
    "Temperatura": _celsius(1),
    "Ponto de Orvalho": _celsius(2),
    "Velocidade do Vento": _wind(2),
    "Direção do Vento": _wind(1),
    "Visibilidade": f"CASE WHEN t LIKE '% CAVOK %' OR {_METRES} = 9999 THEN 10000.0::DOUBLE ELSE coalesce({_METRES}, {_MILES}) END",
    "Pressão": """coalesce(TRY_CAST(nullif(regexp_extract(t, ' Q([0-9]{4})([ =]|$)', 1), '') AS DOUBLE),
        round(TRY_CAST(nullif(regexp_extract(t, ' A([0-9]{4})([ =]|$)', 1), '') AS DOUBLE) / 100 * 33.8638866667::DOUBLE, 1))""",
    "Tempo": f"nullif(array_to_string([x FOR x IN string_split(rtrim(t, '='), ' ') IF regexp_full_match(x, '{_WX}')], ', '), '')",
    "Céu": f"nullif(array_to_string([x FOR x IN string_split(rtrim(t, '='), ' ') IF regexp_full_match(x, '{_SKY}')], ', '), '')",
}


def parsed_sql(source: str) -> str:
    fields = ", ".join(f'CASE WHEN {_OK} THEN {e} END AS "{n}"' for n, e in _FIELDS.items())
    return f"SELECT event_id, hour_ts, aero, {_OK} AS parse_ok, {fields} FROM {source}"


def stats_sql(source: str, suffix: str) -> str:
    functions = {"mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}
    cells = ", ".join(f'{f}("{c}") AS "{c}{n}{suffix}"' for c in NUMERIC_FIELDS for n, f in functions.items())
    return f"SELECT aero, hour_ts, {cells} FROM {source} GROUP BY aero, hour_ts"


def weather_names(suffix: str) -> list[str]:
    return [f"{c}{n}{suffix}" for c in NUMERIC_FIELDS for n in ("mean", "min", "max", "std")]


def _hourly(parsed):
    """Hourly statistics, rounded once per airport and hour; a flight's cells are copies of them."""
    return rounded(weather.hourly_weather(parsed), 4)


_COLUMNS = ", ".join(f'"{c}"' for c in [*NUMERIC_FIELDS, *TEXT_FIELDS])


@_add(
    "metar_parse",
    sql(f"SELECT event_id, CAST(parse_ok AS INT) AS parse_ok, {_COLUMNS} FROM parsed", "tidied", parsed=parsed_sql("tidied")),
)
def metar_parse(spark, d):
    out = weather.parse_reports(s.reports(spark, d), "metar")
    return out.select("event_id", F.col("parse_ok").cast("int").alias("parse_ok"), *NUMERIC_FIELDS, *TEXT_FIELDS)


@_add(
    "metaf_parse",
    sql(
        f"SELECT event_id, CAST(parse_ok AS INT) AS parse_ok, {_COLUMNS} FROM parsed",
        "tidied_forecasts", parsed=parsed_sql("tidied_forecasts"),
    ),
)
def metaf_parse(spark, d):
    out = weather.parse_reports(s.forecasts(spark, d), "metaf")
    return out.select("event_id", F.col("parse_ok").cast("int").alias("parse_ok"), *NUMERIC_FIELDS, *TEXT_FIELDS)


@_add(
    "parse_rate",
    sql(
        f"SELECT count(*) AS reports, count(*) FILTER (parse_ok) AS parsed, {q('avg(parse_ok::INT)', 6, 'rate')} FROM parsed",
        "tidied", parsed=parsed_sql("tidied"),
    ),
)
def parse_rate(spark, d):
    return rounded(weather.parse_rate(weather.parse_reports(s.reports(spark, d), "metar")))


def _stats_query(suffix: str) -> str:
    cells = ", ".join(q(f'"{n}"', 4) for n in weather_names(suffix))
    return f"SELECT flightid, {cells} FROM flights LEFT JOIN w ON aero = destino AND hour_ts = arr_hour"


@_add(
    "weather_stats",
    sql(_stats_query("_x"), "flights", "tidied", parsed=parsed_sql("tidied"), w=stats_sql("parsed", "_x")),
)
def weather_stats(spark, d):
    hourly = _hourly(weather.parse_reports(s.reports(spark, d), "metar"))
    out = weather.attach_weather(movements(spark, d), hourly, "destino", "arr_hour", "_x")
    return out.select("flightid", *[F.col(f"`{n}`") for n in weather_names("_x")])


@_add(
    "weather_stats_both_ends",
    sql(
        f"""SELECT flightid, {q('o."Temperaturamean"', 4, '"Temperaturamean_x"')}, {q('o."Pressãostd"', 4, '"Pressãostd_x"')},
        {q('e."Temperaturamean"', 4, '"Temperaturamean_y"')}, {q('e."Pressãostd"', 4, '"Pressãostd_y"')}
        FROM flights LEFT JOIN w o ON o.aero = origem AND o.hour_ts = dep_hour
        LEFT JOIN w e ON e.aero = destino AND e.hour_ts = arr_hour""",
        "flights", "tidied", parsed=parsed_sql("tidied"), w=stats_sql("parsed", ""),
    ),
)
def weather_stats_both_ends(spark, d):
    hourly = _hourly(weather.parse_reports(s.reports(spark, d), "metar"))
    out = weather.attach_blocks(movements(spark, d), [(hourly, "origem", "dep_hour", "_x"), (hourly, "destino", "arr_hour", "_y")])
    names = [f"{n}{side}" for side in ("_x", "_y") for n in ("Temperaturamean", "Pressãostd")]
    return out.select("flightid", *[F.col(f"`{n}`") for n in names])


_BLOCKS = (("wo", "_x", "origem", "dep_hour"), ("wo", "_y", "destino", "arr_hour"), ("wf", "_fx", "origem", "dep_hour"), ("wf", "_fy", "destino", "arr_hour"))


def _block_cells() -> str:
    return ", ".join(q(f'{side[1:]}."{n}"', 4, f'"{n}{side}"') for _, side, _, _ in _BLOCKS for n in weather_names(""))


def _block_joins() -> str:
    return " ".join(f"LEFT JOIN {w} {side[1:]} ON {side[1:]}.aero = {place} AND {side[1:]}.hour_ts = {hour}" for w, side, place, hour in _BLOCKS)


@_add(
    "weather_four_blocks",
    sql(
        f"SELECT flightid, {_block_cells()} FROM flights {_block_joins()}",
        "flights", "tidied", "tidied_forecasts", observed=parsed_sql("tidied"), forecast=parsed_sql("tidied_forecasts"),
        wo=stats_sql("observed", ""), wf=stats_sql("forecast", ""),
    ),
)
def weather_four_blocks(spark, d):
    """Observed and forecast weather at both ends of each flight: four blocks of 24 statistics."""
    hourly = {
        "wo": _hourly(weather.parse_reports(s.reports(spark, d), "metar")),
        "wf": _hourly(weather.parse_reports(s.forecasts(spark, d), "metaf")),
    }
    out = weather.attach_blocks(movements(spark, d), [(hourly[table], place, hour, side) for table, side, place, hour in _BLOCKS])
    return out.select("flightid", *[F.col(f"`{n}{side}`") for _, side, _, _ in _BLOCKS for n in weather_names("")])


_FILLED = ", ".join(f'coalesce("{c}", -99) AS "{c}"' for c in NUMERIC_FIELDS)


@_add(
    "weather_stats_filled",
    sql(
        f"""SELECT aero, strftime(hour_ts, '%Y-%m-%d %H') AS hour, {', '.join(q(f'"{n}"', 4) for n in weather_names(''))} FROM w""",
        "tidied", parsed=parsed_sql("tidied"),
        filled=f"SELECT aero, hour_ts, {_FILLED} FROM parsed", w=stats_sql("filled", ""),
    ),
)
def weather_stats_filled(spark, d):
    hourly = weather.hourly_weather(weather.parse_reports(s.reports(spark, d), "metar"), fill=-99)
    out = hourly.withColumn("hour", F.date_format("hour_ts", "yyyy-MM-dd HH"))
    return out.select("aero", "hour", *[r(F.col(f"`{n}`"), 4).alias(n) for n in weather_names("")])


@_add(
    "first_report_per_key",
    sql(
        """SELECT aero, strftime(hour_ts, '%Y-%m-%d %H') AS hour, arg_min(metar, (hora, event_id)) AS metar
        FROM reports GROUP BY aero, hour_ts""",
        "reports",
    ),
)
def first_report_per_key(spark, d):
    rows = s.reports(spark, d).withColumn("hour", F.date_format(F.timestamp_millis("hora"), "yyyy-MM-dd HH"))
    return weather.first_report(rows, ["aero", "hour"], "metar", ["hora", "event_id"])
