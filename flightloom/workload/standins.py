"""The source tables of the domain, derived from the generic test tables.

Each one exists twice, as a DataFrame and as a SQL common table expression, so that a
query and its check start from the same rows. Every table keeps all rows of its base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START_MS = 1704067200000  # 2024-01-01, where the events begin
MONTH_S = 2592000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison. The tiny addend takes exact halves, which the two engines
    round differently, off the edge; the result is never minus zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def q(expression: str, digits: int = 6, name: str | None = None) -> str:
    """The same rounding as SQL text."""
    return f"round({expression} + 1e-{digits + 3}, {digits}) + 0.0::DOUBLE AS {name or expression}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded."""
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: r(F.col(f"`{c}`"), digits) for c in doubles})


def code(n: Column) -> Column:
    return F.concat(F.lit("SB"), F.chr(F.lit(65) + F.floor(n / 5)), F.chr(F.lit(75) + n % 5))


def _epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def _departure_ms(key: Column) -> Column:
    return F.lit(START_MS) + (key * 7919) % MONTH_S * 1000


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights from orders; origin through the customer's nation."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    both = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left")
    dep = _departure_ms(F.col("o_orderkey")) + F.col("o_custkey") % 1000
    return both.select(
        F.col("o_orderkey").alias("flightid"),
        code(F.col("c_nationkey")).alias("origem"),
        code((F.col("o_orderkey") * 11 + F.col("o_custkey")) % 25).alias("destino"),
        dep.alias("dt_dep"),
        (dep + F.floor(F.col("o_totalprice") * 10).cast("long") - 300000).alias("dt_arr"),
    )


def points_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points from order lines, positions in degrees."""
    at = (
        _departure_ms(F.col("l_orderkey"))
        + (F.col("l_linenumber") - 1) * 600000
        + (F.col("l_partkey") * 131 + F.col("l_suppkey") * 7) % 600000
    )
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("flightid"),
        ((F.col("l_partkey") * 17 + F.col("l_linenumber") * 3) % 140 - 70).cast("double").alias("lat"),
        ((F.col("l_suppkey") * 97 + F.col("l_partkey") * 31) % 340 - 170).cast("double").alias("lon"),
        F.col("l_extendedprice").alias("flightlevel"),
        F.col("l_quantity").alias("speed"),
        at.alias("dt_radar"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points as radar delivers them, positions in radians."""
    return points_degrees(spark, sf_dir).withColumns({"lat": F.radians("lat"), "lon": F.radians("lon")})


def gappy_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with unknown positions, and several points of a flight at the same time."""
    second = F.floor(F.col("dt_radar") / 1000)
    return points(spark, sf_dir).withColumns(
        {
            "lat": F.when(second % 7 != 0, F.col("lat")),
            "lon": F.when((second % 7 != 0) & (second % 11 != 0), F.col("lon")),
            "dt_radar": F.col("dt_radar") - F.col("dt_radar") % 1200000,
        }
    )


def hourly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_degrees(spark, sf_dir).withColumn(
        "hour_ts", F.date_trunc("hour", F.timestamp_millis("dt_radar"))
    )


def _airport() -> Column:
    return code(F.col("user_id") % 25)


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        _epoch_ms(F.col("ts")).alias("hora"), _airport().alias("aero"), F.col("value").alias("esperas")
    )


def predicted_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        _epoch_ms(F.col("ts")).alias("hora"),
        F.substring(_airport(), 3, 2).alias("aero"),
        F.when(F.col("value") > 50, 1.0).otherwise(0.0).alias("troca"),
    )


def actual_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicted_changes(spark, sf_dir).drop("troca")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One coded report per event; some are not reports at all."""
    e, u = F.col("event_id"), F.col("user_id")
    blank = F.lit("")
    text = F.concat(
        F.lit("METAR "), _airport(), F.lit(" "), F.date_format("ts", "ddHHmm"), F.lit("Z "),
        F.when(e % 11 == 0, "VRB").otherwise(F.lpad((e * 10 % 360).cast("string"), 3, "0")), _two(e % 40),
        F.when(e % 7 == 0, "G35").otherwise(blank), F.lit("KT "),
        F.when(e % 19 == 0, "1 1/2SM").when(e % 19 == 1, "10SM").when(e % 19 == 2, "3/4SM").when(e % 5 == 0, "CAVOK").when(e % 5 == 1, "9999").otherwise(F.lpad((e % 90 * 100).cast("string"), 4, "0")),
        F.lit(" "),
        F.when(e % 4 == 0, "-RA ").when(e % 4 == 1, "TSRA BR ").otherwise(blank),
        F.when(e % 3 == 0, "BKN020 SCT030CB ").when(e % 3 == 1, "FEW008 ").otherwise(blank),
        F.when(u % 13 == 0, "M").otherwise(blank), _two(u % 40), F.lit("/"),
        F.when(e % 17 == 0, blank).otherwise(F.concat(F.when(e % 6 == 0, "M").otherwise(blank), _two(e % 30))),
        F.lit(" "),
        F.when(e % 9 == 0, F.concat(F.lit("A"), (e % 100 + 2900).cast("string"))).otherwise(
            F.concat(F.lit("Q"), F.lpad((e % 40 + 990).cast("string"), 4, "0"))
        ),
        F.when(e % 8 == 3, " TEMPO 1000 TSRA OVC005").when(e % 8 == 5, " BECMG BKN010").when(e % 8 == 6, " RMK FZRA A2992").otherwise(blank),
        F.lit("="),
    )
    text = F.when(e % 23 == 0, F.concat(F.lit("garbage "), e.cast("string"))).otherwise(text)
    return read(spark, sf_dir, "events").select(
        e.alias("event_id"), _epoch_ms(F.col("ts")).alias("hora"), _airport().alias("aero"), text.alias("metar")
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reports as forecasts with untidy spacing."""
    untidy = F.replace(F.replace("metar", F.lit("METAR"), F.lit("METAF")), F.lit(" "), F.lit("  "))
    return reports(spark, sf_dir).select("event_id", "hora", "aero", untidy.alias("metaf"))


def storms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    return read(spark, sf_dir, "events").select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour_ts"),
        ((u * 37 + e) % 140 - 70).cast("double").alias("lat"),
        (e * 53 % 340 - 170).cast("double").alias("lon"),
        (F.col("value") * 20).alias("radius_km"),
    )


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 vertices per embedding; its label is the image."""
    pair = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda j: F.struct(
            j.alias("vertice"),
            F.element_at("embedding", j * 2 + 1).cast("double").alias("x"),
            F.element_at("embedding", j * 2 + 2).cast("double").alias("y"),
        ),
    )
    flat = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("image"), F.col("vec_id").alias("poly"), F.floor(F.size("embedding") / 2).cast("int").alias("n_vertices"),
        F.explode(pair).alias("_v"),
    )
    return flat.select("image", "poly", "_v.vertice", "_v.x", "_v.y", "n_vertices")


def pixel_vertices(spark: SparkSession, sf_dir: str, scale: int = 1000, shift: int = 500) -> DataFrame:
    px = {c: (F.floor(F.col(c) * scale) + shift).cast("int") for c in ("x", "y")}
    return vertices(spark, sf_dir).withColumns(px)


def polygon_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON with four polygons of eight vertices per embedding."""

    def px(i: Column) -> Column:
        return (F.floor(F.element_at("embedding", i).cast("double") * 1000) + 500).cast("int")

    rings = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda p: F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda v: F.array(F.array(px(p * 16 + v * 2 + 1), px(p * 16 + v * 2 + 2))),
        ),
    )
    return read(spark, sf_dir, "embeddings").select(
        F.concat(F.col("vec_id").cast("string"), F.lit(".jpg")).alias("data"), F.to_json(rings).alias("json")
    )


def geo_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track points with the image bucket their flight belongs to."""
    return points_degrees(spark, sf_dir).select(
        "flightid", "dt_radar", (F.col("lon") / 4).alias("lon"), (F.col("lat") / 3).alias("lat"),
        (F.col("flightid") % 10).cast("int").alias("bucket"),
    )


def geo_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storm polygons some degrees wide, spread over the area of the tracks."""
    return vertices(spark, sf_dir).select(
        F.col("image").cast("int").alias("bucket"), "poly", "vertice",
        (F.col("x") * 30 + (F.col("poly") * 37 % 80 - 40)).alias("x"),
        (F.col("y") * 20 + (F.col("poly") * 53 % 46 - 23)).alias("y"), "n_vertices",
    )


def scoring_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights to score, with the image they refer to."""
    stamp = F.date_format(F.timestamp_millis("dt_dep"), "yyyyMMddHHmm")
    path = F.concat(F.lit("http://img/x/S11635384_"), stamp, F.lit(".jpg"))
    return movements(spark, sf_dir).select("flightid", "origem", "destino", path.alias("path"), "dt_dep")


_CODE = "('SB' || chr((65 + ({n}) // 5)::INT) || chr((75 + ({n}) % 5)::INT))"
_DEP = "(1704067200000 + ({k} * 7919) % 2592000 * 1000)"
_AERO = _CODE.format(n="user_id % 25")

def _summary(source: str) -> str:
    """First and last known values by time, then position; NULL distance where an end is unknown."""
    ends = []
    for c in ("lat", "lon"):
        for name, f in (("first", "arg_min"), ("last", "arg_max")):
            ends.append(f"{f}({c}, (dt_radar, coalesce(lat, -90), coalesce(lon, -180))) FILTER ({c} IS NOT NULL) AS {c}_{name}")
    return f"""
        SELECT *, 2 * 6371.0 * asin(sqrt(CASE WHEN a > 1 THEN 1.0 ELSE a END)) AS distancia FROM (
        SELECT *, pow(sin(radians(lat_last - lat_first) / 2), 2)
                  + cos(radians(lat_first)) * cos(radians(lat_last)) * pow(sin(radians(lon_last - lon_first) / 2), 2) AS a FROM (
        SELECT flightid, count(*) AS n_points, (max(dt_radar) - min(dt_radar)) / 1000.0 AS duration, {", ".join(ends)},
               avg(flightlevel) AS flightlevel_mean, min(flightlevel) AS flightlevel_min,
               max(flightlevel) AS flightlevel_max, stddev_samp(flightlevel) AS flightlevel_std,
               avg(speed) AS speed_mean, min(speed) AS speed_min, max(speed) AS speed_max, stddev_samp(speed) AS speed_std
        FROM {source} GROUP BY flightid))"""


SQL = {
    "movements": f"""
        SELECT o_orderkey AS flightid, {_CODE.format(n='c_nationkey')} AS origem,
               {_CODE.format(n='(o_orderkey * 11 + o_custkey) % 25')} AS destino,
               {_DEP.format(k='o_orderkey')} + o_custkey % 1000 AS dt_dep,
               {_DEP.format(k='o_orderkey')} + o_custkey % 1000 + CAST(floor(o_totalprice * 10) AS BIGINT) - 300000 AS dt_arr
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "flights": """
        SELECT flightid, origem, destino, origem || destino AS linha,
               CAST(floor((dt_arr - dt_dep) / 1000.0) AS BIGINT) AS target,
               make_timestamp(dt_dep * 1000) AS dep, make_timestamp(dt_arr * 1000) AS arr,
               CAST(isodow(make_timestamp(dt_dep * 1000)) - 1 AS INT) AS diaSemana,
               CAST(hour(make_timestamp(dt_dep * 1000)) AS INT) AS hora,
               date_trunc('hour', make_timestamp(dt_dep * 1000)) AS dep_hour,
               date_trunc('hour', make_timestamp(dt_arr * 1000)) AS arr_hour
        FROM movements""",
    "points": f"""
        SELECT l_orderkey AS flightid,
               CAST((l_partkey * 17 + l_linenumber * 3) % 140 - 70 AS DOUBLE) AS lat,
               CAST((l_suppkey * 97 + l_partkey * 31) % 340 - 170 AS DOUBLE) AS lon,
               l_extendedprice AS flightlevel, l_quantity AS speed,
               {_DEP.format(k='l_orderkey')} + (l_linenumber - 1) * 600000 + (l_partkey * 131 + l_suppkey * 7) % 600000 AS dt_radar
        FROM lineitem""",
    "gappy": """
        SELECT flightid, CASE WHEN dt_radar // 1000 % 7 = 0 THEN NULL ELSE lat END AS lat,
               CASE WHEN dt_radar // 1000 % 7 = 0 OR dt_radar // 1000 % 11 = 0 THEN NULL ELSE lon END AS lon,
               flightlevel, speed, dt_radar - dt_radar % 1200000 AS dt_radar FROM points""",
    "summary": _summary("points"),
    "gappy_summary": _summary("gappy"),
    "holdings": f"""
        SELECT epoch_us(ts) // 1000 AS hora_ms, date_trunc('hour', ts) AS hour_ts, CAST(hour(ts) AS INT) AS hora,
               CAST(isodow(ts) - 1 AS INT) AS diaSemana, {_AERO} AS aero, substr({_AERO}, 3) AS short,
               value AS esperas, CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS troca
        FROM events""",
    "reports": f"""
        SELECT event_id, epoch_us(ts) // 1000 AS hora, date_trunc('hour', ts) AS hour_ts, {_AERO} AS aero,
          CASE WHEN event_id % 23 = 0 THEN 'garbage ' || event_id ELSE
          'METAR ' || {_AERO} || ' ' || strftime(ts, '%d%H%M') || 'Z '
          || CASE WHEN event_id % 11 = 0 THEN 'VRB' ELSE lpad((event_id * 10 % 360)::VARCHAR, 3, '0') END
          || lpad((event_id % 40)::VARCHAR, 2, '0') || CASE WHEN event_id % 7 = 0 THEN 'G35' ELSE '' END || 'KT '
          || CASE WHEN event_id % 19 = 0 THEN '1 1/2SM' WHEN event_id % 19 = 1 THEN '10SM' WHEN event_id % 19 = 2 THEN '3/4SM'
                  WHEN event_id % 5 = 0 THEN 'CAVOK' WHEN event_id % 5 = 1 THEN '9999' ELSE lpad((event_id % 90 * 100)::VARCHAR, 4, '0') END
          || ' ' || CASE WHEN event_id % 4 = 0 THEN '-RA ' WHEN event_id % 4 = 1 THEN 'TSRA BR ' ELSE '' END
          || CASE WHEN event_id % 3 = 0 THEN 'BKN020 SCT030CB ' WHEN event_id % 3 = 1 THEN 'FEW008 ' ELSE '' END
          || CASE WHEN user_id % 13 = 0 THEN 'M' ELSE '' END || lpad((user_id % 40)::VARCHAR, 2, '0') || '/'
          || CASE WHEN event_id % 17 = 0 THEN '' ELSE CASE WHEN event_id % 6 = 0 THEN 'M' ELSE '' END || lpad((event_id % 30)::VARCHAR, 2, '0') END
          || ' ' || CASE WHEN event_id % 9 = 0 THEN 'A' || (event_id % 100 + 2900) ELSE 'Q' || lpad((event_id % 40 + 990)::VARCHAR, 4, '0') END
          || CASE event_id % 8 WHEN 3 THEN ' TEMPO 1000 TSRA OVC005' WHEN 5 THEN ' BECMG BKN010' WHEN 6 THEN ' RMK FZRA A2992' ELSE '' END
          || '=' END AS metar
        FROM events""",
    "forecasts": """
        SELECT event_id, hora, hour_ts, aero, replace(replace(metar, 'METAR', 'METAF'), ' ', '  ') AS metaf FROM reports""",
    "tidied": """
        SELECT event_id, hour_ts, aero, regexp_replace(metar, ' (TEMPO|BECMG|RMK) .*', '=') AS t FROM reports""",
    "tidied_forecasts": """
        SELECT event_id, hour_ts, aero,
               regexp_replace(trim(regexp_replace(replace(metaf, 'METAF', 'METAR'), '\\s+', ' ', 'g')), ' (TEMPO|BECMG|RMK) .*', '=') AS t
        FROM forecasts""",
    "storms": """
        SELECT event_id, date_trunc('hour', ts) AS hour_ts, CAST((user_id * 37 + event_id) % 140 - 70 AS DOUBLE) AS lat,
               CAST(event_id * 53 % 340 - 170 AS DOUBLE) AS lon, value * 20 AS radius_km
        FROM events""",
    "vertices": """
        SELECT label AS image, vec_id AS poly, CAST(j AS INT) AS vertice,
               CAST(embedding[2 * j + 1] AS DOUBLE) AS x, CAST(embedding[2 * j + 2] AS DOUBLE) AS y
        FROM embeddings, range(32) AS t(j)""",
    "pixel_vertices": """
        SELECT image, poly, vertice, CAST(floor(x * 1000) + 500 AS INT) AS x, CAST(floor(y * 1000) + 500 AS INT) AS y FROM vertices""",
    "geo_points": """
        SELECT flightid, dt_radar, lon / 4 AS lon, lat / 3 AS lat, CAST(flightid % 10 AS INT) AS bucket FROM points""",
    "geo_vertices": """
        SELECT CAST(image AS INT) AS bucket, poly, vertice, x * 30 + (poly * 37 % 80 - 40) AS x, y * 20 + (poly * 53 % 46 - 23) AS y FROM vertices""",
    "geo_edges": """
        SELECT a.bucket, a.poly, a.vertice, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM geo_vertices a JOIN geo_vertices b
          ON a.bucket = b.bucket AND a.poly = b.poly AND b.vertice = (a.vertice + 1) % 32""",
    "slim": """
        SELECT flightid, dt_radar, lon, lat, bucket, count(*) AS copies FROM geo_points GROUP BY ALL""",
    "contained": """
        SELECT s.flightid, s.dt_radar, s.lon, s.lat, s.bucket, s.copies, e.poly
        FROM slim s JOIN geo_edges e ON s.bucket = e.bucket
          AND (e.y1 > s.lat) <> (e.y2 > s.lat)
          AND s.lon < (e.x2 - e.x1) * (s.lat - e.y1) / (e.y2 - e.y1) + e.x1
        GROUP BY ALL HAVING count(*) % 2 = 1""",
    "marked": """
        SELECT s.*, CASE WHEN c.flightid IS NULL THEN 0 ELSE 1 END AS inside
        FROM slim s LEFT JOIN (SELECT DISTINCT flightid, dt_radar, lon, lat, bucket FROM contained) c
          USING (flightid, dt_radar, lon, lat, bucket)""",
}

_NEEDS = {
    "flights": ["movements"],
    "gappy": ["points"],
    "summary": ["points"],
    "gappy_summary": ["points", "gappy"],
    "forecasts": ["reports"],
    "tidied": ["reports"],
    "tidied_forecasts": ["reports", "forecasts"],
    "pixel_vertices": ["vertices"],
    "geo_points": ["points"],
    "geo_vertices": ["vertices"],
    "geo_edges": ["vertices", "geo_vertices"],
    "slim": ["points", "geo_points"],
    "contained": ["points", "geo_points", "slim", "vertices", "geo_vertices", "geo_edges"],
    "marked": ["points", "geo_points", "slim", "vertices", "geo_vertices", "geo_edges", "contained"],
}


def sql(query: str, *tables: str, **extra: str) -> str:
    """A query with the stand-in tables it names (and further named parts) in front."""
    names: list[str] = []
    for table in tables:
        for name in [*_NEEDS.get(table, []), table]:
            if name not in names:
                names.append(name)
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra.items()]
    recursive = "RECURSIVE " if "UNION" in " ".join(extra.values()) else ""
    return (f"WITH {recursive}{', '.join(parts)} " if parts else "") + query
