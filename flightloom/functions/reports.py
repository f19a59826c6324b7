"""Coded weather reports to columns: one pass of regular expressions, no Python rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import join_list, squeeze_spaces, swap_word

# The eight fields a report yields, in output order.
NUMERIC_FIELDS = [
    "Temperatura",
    "Ponto de Orvalho",
    "Velocidade do Vento",
    "Direção do Vento",
    "Visibilidade",
    "Pressão",
]
TEXT_FIELDS = ["Tempo", "Céu"]

# Patterns of the report groups.
HEADER = r"^(METAR|SPECI) (COR )?[A-Z][A-Z0-9]{3} [0-9]{6}Z "
TEMPERATURE = r" (M?[0-9]{2})/(M?[0-9]{2})?([ =]|$)"
WIND = r" ([0-9]{3}|VRB)([0-9]{2,3})(G[0-9]{2,3})?(KT|MPS|KMH) "
METRES = r" ([0-9]{4})([NSEW]{1,2}|NDV)?([ =]|$)"
MILES = r" (?:M|P)?(?:([0-9]{1,2}) ?)?(?:([0-9])/([0-9]{1,2}))?SM([ =]|$)"
# What follows is a forecast or a remark, not observed weather; it begins with one of these words.
TREND_WORDS = (" TEMPO", " BECMG", " NOSIG", " RMK", " PROB", " FM")
TREND = r" (TEMPO|BECMG|NOSIG|RMK|PROB[0-9]{2}|FM[0-9]{4,6})( .*|=.*|$)"
METRES_IN_MILE, HECTOPASCAL_IN_INCH = 1609.344, 33.8638866667
CLEAR = r" CAVOK([ =]|$)"
HECTOPASCAL = r" Q([0-9]{4})([ =]|$)"
INCHES = r" A([0-9]{4})([ =]|$)"
WEATHER = (
    r" ((?:-|\+|VC)?(?:MI|PR|BC|DR|BL|SH|TS|FZ)?"
    r"(?:(?:DZ|RA|SN|SG|IC|PL|GR|GS|UP|BR|FG|FU|VA|DU|SA|HZ|PY|PO|SQ|FC|SS|DS)+|TS|SH))(?=[ =]|$)"
)
SKY = r" ((?:FEW|SCT|BKN|OVC|VV)[0-9]{3}(?:CB|TCU)?|SKC|CLR|NSC|NCD)(?=[ =]|$)"


def tidy(report: Column) -> Column:
    """Single spaces, and forecasts named like observations."""
    return squeeze_spaces(swap_word(report, "METAF", "METAR"))


def observed(report: Column) -> Column:
    """The report up to its trend or remarks."""
    marked = F.lit(False)
    for word in TREND_WORDS:
        marked = marked | report.contains(word)
    return F.when(marked, F.regexp_replace(report, TREND, "=")).otherwise(report)


def _group(pattern: str, number: int, text: str = "_text") -> Column:
    return F.nullif(F.regexp_extract(text, pattern, number), F.lit(""))


def _all_groups(pattern: str) -> Column:
    found = F.regexp_extract_all("_text", F.lit(pattern), F.lit(1))
    return F.nullif(join_list(found), F.lit(""))


# One search of the whole report per group; a group's parts are then read from the few letters that were found.
_RAW = {
    "parse_ok": lambda: F.coalesce(F.col("_text").rlike(HEADER), F.lit(False)),
    "_found_temperature": lambda: _group(TEMPERATURE, 0),
    "_found_wind": lambda: _group(WIND, 0),
    "_metres": lambda: _group(METRES, 1),
    "_found_miles": lambda: F.when(F.col("_text").contains("SM"), _group(MILES, 0)),
    "_clear": lambda: F.col("_text").rlike(CLEAR),
    "_hectopascal": lambda: _group(HECTOPASCAL, 1),
    "_inches": lambda: _group(INCHES, 1),
    "_weather": lambda: _all_groups(WEATHER),
    "_sky": lambda: _all_groups(SKY),
}
_PARTS = {
    "_temperature": lambda: _group(TEMPERATURE, 1, "_found_temperature"),
    "_dew": lambda: _group(TEMPERATURE, 2, "_found_temperature"),
    "_speed": lambda: _group(WIND, 2, "_found_wind"),
    "_direction": lambda: _group(WIND, 1, "_found_wind"),
    "_miles": lambda: _group(MILES, 1, "_found_miles"),
    "_over": lambda: _group(MILES, 2, "_found_miles"),
    "_under": lambda: _group(MILES, 3, "_found_miles"),
}


def _number(name: str) -> Column:
    return F.col(name).try_cast("double")


def _celsius(name: str) -> Column:
    size = F.replace(F.col(name), F.lit("M"), F.lit("")).try_cast("double")
    return F.when(F.col(name).startswith("M"), -size).otherwise(size)


def add_report_columns(df: DataFrame, report: str) -> DataFrame:
    """Add the eight fields and ``parse_ok``; a report without a proper header gives NULLs.

    Visibility is in metres and pressure in hectopascal, also where the report has miles (with
    fractions) or inches. Trends and remarks after the observation are not read.

    Five projections, each using the columns of the one before, so that the text is
    tidied once and each pattern is searched once per row.
    """
    part = _number("_over") / F.nullif(_number("_under"), F.lit(0.0))
    miles = F.when(F.col("_miles").isNotNull() | F.col("_over").isNotNull(), F.coalesce(_number("_miles"), F.lit(0.0)) + F.coalesce(part, F.lit(0.0)))
    fields = {
        "Temperatura": _celsius("_temperature"),
        "Ponto de Orvalho": _celsius("_dew"),
        "Velocidade do Vento": _number("_speed"),
        "Direção do Vento": _number("_direction"),
        "Visibilidade": F.when(F.col("_clear") | (F.col("_metres") == "9999"), F.lit(10000.0)).otherwise(
            F.coalesce(_number("_metres"), F.round(miles * F.lit(METRES_IN_MILE), 1))
        ),
        "Pressão": F.coalesce(_number("_hectopascal"), F.round(_number("_inches") / 100 * F.lit(HECTOPASCAL_IN_INCH), 1)),
        "Tempo": F.col("_weather"),
        "Céu": F.col("_sky"),
    }
    tidied = df.withColumn("_tidy", tidy(F.col(report))).withColumn("_text", observed(F.col("_tidy")))
    searched = tidied.withColumns({n: c() for n, c in _RAW.items()})
    searched = searched.withColumns({n: c() for n, c in _PARTS.items()})
    read = searched.withColumns({n: F.when(F.col("parse_ok"), c) for n, c in fields.items()})
    return read.drop("_tidy", "_text", *[n for n in (*_RAW, *_PARTS) if n != "parse_ok"])
