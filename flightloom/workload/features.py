"""Queries on the composite feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import features, storms
from ..plans.submission import linear_submission
from ..sources.schemas import FEATURES
from . import standins as s
from .exposures import _NEAR, _PER_POINT
from .registry import Registry
from .reports import parsed_sql, stats_sql, weather_names
from .standins import q, r, sql
from .tracks import history_sql

REGISTRY = Registry()
_add = REGISTRY.add

_CODES = ("origem", "destino", "linha")
_PLAIN = (*_CODES, "diaSemana", "hora", "sum(flight_through_area)")


def _code_sql(column: str) -> str:
    return f"""SELECT value, CAST(row_number() OVER (ORDER BY first, value) - 1 AS INT) AS code
        FROM (SELECT {column} AS value, min(flightid) AS first FROM flights GROUP BY 1)"""


_PARTS = {
    "history": history_sql("summary"),
    "parsed_x": parsed_sql("tidied"),
    "parsed_y": parsed_sql("tidied_forecasts"),
    "wx": stats_sql("parsed_x", "_x"),
    "wy": stats_sql("parsed_y", "_y"),
    "near": _NEAR,
    "exposed": _PER_POINT.replace("n.flightid", "n.event_id"),
    "exposure": 'SELECT flightid, CAST(sum(flight_through_area) AS BIGINT) AS total FROM exposed GROUP BY 1',
    "hours": "SELECT hour_ts AS h, sum(esperas) AS esperas, sum(troca) AS troca FROM holdings GROUP BY 1",
    **{f"code_{c}": _code_sql(c) for c in _CODES},
}
_EXPRESSIONS = {
    "esperas": "coalesce(hours.esperas, 0)",
    "troca": "coalesce(hours.troca, 0)",
    "dt_radar_lambda": "h.duration_mean",
    "dt_radar_lambda1": "h.duration_min",
    "dt_radar_lambda2": "h.duration_max",
    "dt_radar_lambda3": "h.duration_std",
    "distancia_": "h.distancia",
    **{n: f"h.{n}" for n in ("flightlevel_mean", "flightlevel_max", "flightlevel_std", "flightlevel_std1", "speed_std", "speed_std1")},
    "mean_x": "a.m", "sum_x": "a.s", "mean_y": "b.m", "sum_y": "b.s", "mean": "c.m", "sum": "c.s",
    **{n: f'wx."{n}"' for n in weather_names("_x")},
    **{n: f'wy."{n}"' for n in weather_names("_y")},
}


def _feature_sql(hour: str, first: str, where: str = "") -> str:
    cells = [first]
    for name in FEATURES:
        if name in _CODES:
            cells.append(f"coalesce(code_{name}.code, -1) AS {name}")
        elif name == "sum(flight_through_area)":
            cells.append(f'CAST(x.total AS DOUBLE) AS "{name}"')
        elif name in ("diaSemana", "hora"):
            cells.append(f"f.{name}")
        else:
            cells.append(q(_EXPRESSIONS[name], 4, f'"{name}"'))
    codes = " ".join(f"LEFT JOIN code_{c} ON code_{c}.value = f.{c}" for c in _CODES)
    return f"""SELECT {', '.join(cells)} FROM flights f
        LEFT JOIN hours ON hours.h = f.dep_hour
        LEFT JOIN (SELECT aero, hora, avg(esperas) AS m, sum(esperas) AS s FROM holdings GROUP BY ALL) a ON a.aero = f.origem AND a.hora = f.hora
        LEFT JOIN (SELECT aero, diaSemana, avg(esperas) AS m, sum(esperas) AS s FROM holdings GROUP BY ALL) b ON b.aero = f.origem AND b.diaSemana = f.diaSemana
        LEFT JOIN (SELECT aero, avg(esperas) AS m, sum(esperas) AS s FROM holdings GROUP BY ALL) c ON c.aero = f.origem
        LEFT JOIN wx ON wx.aero = f.destino AND wx.hour_ts = f.{hour}
        LEFT JOIN wy ON wy.aero = f.destino AND wy.hour_ts = f.{hour}
        LEFT JOIN history h ON h.linha = f.linha LEFT JOIN exposure x ON x.flightid = f.flightid {codes} {where}"""


_BASE = ("flights", "summary", "holdings", "tidied", "tidied_forecasts", "storms")


def _tables(spark, d, flights):
    points = s.points(spark, d)
    exposure = storms.training_exposure(points, s.storms(spark, d))
    return features.build_tables(
        flights, points, s.holdings(spark, d), s.reports(spark, d), s.forecasts(spark, d),
        s.predicted_changes(spark, d), s.actual_changes(spark, d), exposure,
    )


def _shown(df):
    cells = [
        F.col(f"`{c}`") if c in (*_PLAIN, "flightid", "target") else r(F.col(f"`{c}`"), 4).alias(c) for c in df.columns
    ]
    total = "sum(flight_through_area)"
    return df.select(*cells).withColumn(total, F.col(f"`{total}`").cast("double"))


@_add("training_features", sql(_feature_sql("arr_hour", "f.flightid, f.target"), *_BASE, **_PARTS).replace("WITH RECURSIVE", "WITH"))
def training_features(spark, d):
    flights = features.flight_table(s.movements(spark, d))
    return _shown(features.training_table(flights, _tables(spark, d, flights), features.dictionaries(flights)))


@_add(
    "training_features_long",
    sql(_feature_sql("arr_hour", "f.flightid, f.target", "WHERE f.target > 1500"), *_BASE, **_PARTS),
)
def training_features_long(spark, d):
    flights = features.flight_table(s.movements(spark, d))
    return _shown(features.training_table(flights, _tables(spark, d, flights), features.dictionaries(flights), 1500))


@_add("scoring_features", sql(_feature_sql("dep_hour", "f.flightid"), *_BASE, **_PARTS))
def scoring_features(spark, d):
    flights = features.flight_table(s.movements(spark, d))
    return _shown(features.scoring_table(s.scoring_set(spark, d), _tables(spark, d, flights), features.dictionaries(flights)))


_PICTURES = dict(
    edges="""SELECT a.image, a.poly, a.x::DOUBLE AS x1, a.y::DOUBLE AS y1, b.x::DOUBLE AS x2, b.y::DOUBLE AS y2
            FROM pixel_vertices a JOIN pixel_vertices b ON a.image = b.image AND a.poly = b.poly AND b.vertice = (a.vertice + 1) % 32""",
    cells="""SELECT poly, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(poly % 720 AS INT)) AS hour_ts, area / 40 AS radius_km,
            8.0 + (cy + 740.0 - 740.0) * ((-51.848798 - 8.0) / (2192.0 - 740.0)) AS lat,
            -76.538633 + (cx + 940.0 - 940.0) * ((-28.966528 + 76.538633) / (2092.0 - 940.0)) AS lon
            FROM (SELECT poly, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cx,
                  sum((y1 + y2) * (x1 * y2 - x2 * y1)) / (3 * sum(x1 * y2 - x2 * y1)) AS cy FROM edges GROUP BY image, poly)""",
)
_MEETS = """date_trunc('hour', make_timestamp(p.dt_radar * 1000)) = c.hour_ts
            AND 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(c.lat - p.lat) / 2), 2)
                + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2)))) <= c.radius_km"""


def _picture_cells(spark, d):
    at = F.timestamp_millis(F.lit(s.START_MS) + F.col("poly") % 720 * 3600000)
    return storms.storms_by_hour(s.pixel_vertices(spark, d), at, lambda area: area / 40)


@_add(
    "picture_storm_exposure",
    sql(
        f"""SELECT flightid, CAST(sum(hit) AS BIGINT) AS "sum(flight_through_area)" FROM (
            SELECT p.flightid, p.dt_radar, max(CASE WHEN c.poly IS NULL THEN 0 ELSE 1 END) AS hit FROM points p LEFT JOIN cells c
            ON {_MEETS} GROUP BY 1, 2) GROUP BY 1""",
        "points", "pixel_vertices", **_PICTURES,
    ),
)
def picture_storm_exposure(spark, d):
    return storms.training_exposure(s.points(spark, d), _picture_cells(spark, d))


@_add(
    "picture_scoring_exposure",
    sql(
        f"""SELECT flightid, coalesce(hits, 0) AS flight_through_area, strftime(first, '%Y-%m-%d %H') AS first_storm_hour
        FROM (SELECT flightid, min(hour_ts) AS first FROM (SELECT flightid, date_trunc('hour', make_timestamp(dt_radar * 1000)) AS h FROM points)
              LEFT JOIN (SELECT DISTINCT hour_ts FROM cells) ON h = hour_ts GROUP BY 1)
        LEFT JOIN (SELECT flightid, count(*) AS hits FROM points p JOIN cells c ON {_MEETS} GROUP BY 1) USING (flightid)""",
        "points", "pixel_vertices", **_PICTURES,
    ),
)
def picture_scoring_exposure(spark, d):
    out = storms.scoring_exposure(s.points(spark, d), _picture_cells(spark, d))
    return out.withColumn("first_storm_hour", F.date_format("first_storm_hour", "yyyy-MM-dd HH"))


# The whole way from features to predictions: sums of products per fold, and elimination on them.
_FOLDS = 5
_SYSTEM = len(FEATURES) * 2 + 1


def _row_sql(fold: str, last: str) -> str:
    cells = [f'coalesce("{c}"::DOUBLE, -99)' for c in FEATURES] + [f'("{c}" IS NULL)::INT::DOUBLE' for c in FEATURES]
    return f"SELECT t.flightid, {fold} AS fold, s.same, [1.0::DOUBLE, {', '.join(cells)}{last}] AS v"


_FULL = dict(
    same="SELECT flightid, origem = destino AS same FROM flights",
    train=_feature_sql("arr_hour", "f.flightid, f.target"),
    test=_feature_sql("dep_hour", "f.flightid"),
    learned=_row_sql(f"CAST(CAST('0x' || substr(md5(t.flightid || '-42'), 1, 8) AS BIGINT) % {_FOLDS} AS INT)", ", target::DOUBLE")
    + " FROM train t JOIN same s USING (flightid) WHERE NOT s.same",
    cols=f"SELECT fold, j, list(v[j] ORDER BY flightid) AS c FROM learned, range(1, {_SYSTEM + 2}) r(j) GROUP BY fold, j",
    own="SELECT a.fold, a.j AS i, b.j AS j, list_inner_product(a.c, b.c) AS g FROM cols a JOIN cols b ON a.fold = b.fold",
    whole="SELECT i, j, sum(g) AS g FROM own GROUP BY i, j",
    size="SELECT g AS n FROM whole WHERE i = 1 AND j = 1",
    spreads="""SELECT d.j, o.g / n AS m, CASE WHEN d.j = 1 THEN 1.0 WHEN d.g / n - (o.g / n) ** 2 > 1e-9 * greatest((o.g / n) ** 2, 1e-3)
        THEN sqrt(greatest(d.g / n - (o.g / n) ** 2, 0)) ELSE 1.0 END AS s
        FROM (SELECT * FROM whole WHERE i = j) d JOIN (SELECT * FROM whole WHERE i = 1) o ON o.j = d.j, size""",
    rest="SELECT o.fold AS k, o.i, o.j, w.g - o.g AS g FROM own o JOIN whole w ON w.i = o.i AND w.j = o.j",
    edge="SELECT k, j, g FROM rest WHERE i = 1",
    scaled=f"""SELECT r.k, r.i, r.j,
        (r.g - CASE WHEN r.i > 1 THEN a.m * ej.g ELSE 0 END - CASE WHEN r.j BETWEEN 2 AND {_SYSTEM} THEN b.m * ei.g ELSE 0 END
         + CASE WHEN r.i > 1 AND r.j BETWEEN 2 AND {_SYSTEM} THEN a.m * b.m * e.g ELSE 0 END)
        / (a.s * CASE WHEN r.j <= {_SYSTEM} THEN b.s ELSE 1 END) + CASE WHEN r.i = r.j AND r.i > 1 THEN 1e-3 * e.g ELSE 0 END AS g
        FROM rest r JOIN spreads a ON a.j = r.i JOIN spreads b ON b.j = r.j JOIN edge ei ON ei.k = r.k AND ei.j = r.i
        JOIN edge ej ON ej.k = r.k AND ej.j = r.j JOIN edge e ON e.k = r.k AND e.j = 1 WHERE r.i <= {_SYSTEM}""",
    steps=f"""SELECT k, i, list(g ORDER BY j) AS line, 1 AS s FROM scaled GROUP BY k, i
        UNION ALL
        SELECT k, i, CASE WHEN i = s THEN list_transform(line, lambda x: x / line[s])
            ELSE list_transform(list_zip(line, top_line), lambda z: z[1] - line[s] / top_line[s] * z[2]) END, s + 1
        FROM (SELECT *, any_value(line) FILTER (WHERE i = s) OVER (PARTITION BY k) AS top_line FROM steps WHERE s <= {_SYSTEM})""",
    slopes=f"SELECT t.i, avg(t.line[{_SYSTEM + 1}]) / any_value(p.s) AS w, any_value(p.m) AS m FROM steps t JOIN spreads p ON p.j = t.i WHERE t.s = {_SYSTEM + 1} GROUP BY t.i",
    weights="SELECT list(w ORDER BY i) AS w, sum(CASE WHEN i > 1 THEN w * m ELSE 0 END) AS shift FROM slopes",
    scored=_row_sql("0", "") + " FROM test t JOIN same s USING (flightid)",
)


@_add(
    "submission_full",
    sql(f"""SELECT flightid AS "ID", {q('CASE WHEN same THEN 0.0 ELSE list_inner_product(v, w) - shift END', 3, 'solution')} FROM scored, weights""", *_BASE, **_PARTS, **_FULL),
)
def submission_full(spark, d):
    """All features of the contract with missing-value columns, five fold models, one prediction per flight to score."""
    flights = features.flight_table(s.movements(spark, d))
    tables, codes = _tables(spark, d, flights), features.dictionaries(flights)
    same = flights.select("flightid", (F.col("origem") == F.col("destino")).alias("same"))
    train = _shown(features.training_table(flights, tables, codes)).join(same, "flightid")
    test = _shown(features.scoring_table(s.scoring_set(spark, d), tables, codes)).join(same, "flightid")
    solution, _ = linear_submission(train, test, FEATURES, _FOLDS)
    return solution.withColumn("solution", r("solution", 3))
