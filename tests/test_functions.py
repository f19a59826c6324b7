import pytest
from pyspark.sql import functions as F

from flightloom.functions import geo, numbers, reports, text, times


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_whole_seconds_round_down_below_zero(spark):
    dep, arr = times.from_epoch_ms(F.lit(2500)), times.from_epoch_ms(F.lit(1000))
    got = one(spark, whole=times.whole_seconds(dep, arr), exact=times.exact_seconds(dep, arr))
    assert (got["whole"], got["exact"]) == (-2, -1.5)


def test_calendar_parts(spark):
    ts = F.to_timestamp(F.lit("2024-01-01 17:45:10"))
    got = one(
        spark, day=times.weekday(ts), hour=times.hour_of_day(ts), text=times.hour_text(ts),
        later=F.date_format(times.add_hours(ts, 8), "yyyy-MM-dd HH:mm"),
    )
    assert tuple(got) == (0, 17, "2024-01-01 17", "2024-01-02 01:45")


def test_bad_time_text_is_null(spark):
    got = one(spark, a=times.parse_timestamp(F.lit("soon")), b=times.parse_date(F.lit("2024-02-30")))
    assert tuple(got) == (None, None)


def test_image_time_of_url(spark):
    path = F.lit("http://h/S11635384_202208250300.jpg")
    got = one(spark, name=text.file_name(path), at=F.date_format(text.image_time(path), "yyyy-MM-dd HH:mm"))
    assert tuple(got) == ("S11635384_202208250300.jpg", "2022-08-25 03:00")


def test_image_time_of_other_path_is_null(spark):
    assert one(spark, at=text.image_time(F.lit("http://h/plain.jpg")))["at"] is None


def test_route_and_suffix(spark):
    got = one(
        spark, a=text.route_key(F.lit("SBGR"), F.lit("SBRJ")), b=text.route_key(F.lit("SBGR"), F.lit(None).cast("string")),
        c=text.drop_prefix(F.lit("SBGR"), 2), d=text.squeeze_spaces(F.lit("  a \n b\t")), e=text.unwrap(F.lit("['SBGR']")),
    )
    assert tuple(got) == ("SBGRSBRJ", None, "GR", "a b", "SBGR")


def test_legacy_label(spark):
    label = F.lit("('2022-06-01 17:00:00.jpg', 3)")
    got = one(
        spark, h=text.label_hour(label), p=text.label_polygon(label),
        t=F.date_format(text.label_time(label), "yyyy-MM-dd HH:mm"),
    )
    assert tuple(got) == ("2022-06-01 17", 3, "2022-06-01 17:00")


@pytest.mark.parametrize("distance", [geo.great_circle_km, geo.great_circle_km_atan])
def test_one_degree_on_the_equator(spark, distance):
    zero = F.lit(0.0)
    assert one(spark, km=distance(zero, zero, zero, F.lit(1.0)))["km"] == pytest.approx(111.194927, abs=1e-6)


def test_opposite_points(spark):
    km = geo.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))
    assert one(spark, km=km)["km"] == pytest.approx(20015.0868, abs=1e-3)


@pytest.mark.parametrize("distance", [geo.great_circle_km, geo.great_circle_km_atan])
def test_unknown_place_has_no_distance(spark, distance):
    zero = F.lit(0.0)
    assert one(spark, km=distance(zero, zero, zero, F.lit(None).cast("double")))["km"] is None


def test_pixel_knots_and_beyond(spark):
    lat, lon = geo.pixel_to_degrees(F.lit(940.0), F.lit(740.0))
    lat2, lon2 = geo.pixel_to_degrees(F.lit(2092.0), F.lit(2192.0))
    lat3, _ = geo.pixel_to_degrees(F.lit(0.0), F.lit(740.0 - 1452.0))
    got = one(spark, a=lat, b=lon, c=lat2, d=lon2, e=lat3)
    assert tuple(got) == pytest.approx((8.0, -76.538633, -51.848798, -28.966528, 8.0 + 59.848798))


def test_swarm_heights(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "k long").select(numbers.side_of_stack(F.col("k")).alias("y"))
    assert [r["y"] for r in df.collect()] == pytest.approx([-0.12, 0.12, -0.24])


LINES = [
    ("METAR SBGR 011700Z 09005KT 9999 -RA BKN020 SCT030CB 24/M02 Q1020=", (24, -2, 5, 90, 10000, 1020, "-RA", "BKN020, SCT030CB", True)),
    ("METAF SBRJ  011700Z VRB12G25KT CAVOK M01/M05 Q1009", (-1, -5, 12, None, 10000, 1009, None, None, True)),
    ("METAR SBSP 011700Z 18010KT 4000 TSRA BR OVC008 18/17 A2992", (18, 17, 10, 180, 4000, 1013.2, "TSRA, BR", "OVC008", True)),
    ("METAR SBSP 011700Z 00000KT 10SM CLR 18/ Q1013", (18, None, 0, 0, 16093.4, 1013, None, "CLR", True)),
    ("METAR SBSP 011700Z 00000KT 1 1/2SM 18/17 Q1013 TEMPO 1000 TSRA OVC005=", (18, 17, 0, 0, 2414.0, 1013, None, None, True)),
    ("METAR SBSP 011700Z 00000KT 3/4SM FEW030 20/10 Q1013 BECMG BKN010=", (20, 10, 0, 0, 1207.0, 1013, None, "FEW030", True)),
    ("METAR SBSP 011700Z 00000KT 8000 20/10 Q1013 RMK A2992 FG", (20, 10, 0, 0, 8000, 1013, None, None, True)),
    ("garbage", (None,) * 8 + (False,)),
    (None, (None,) * 8 + (False,)),
]


@pytest.mark.parametrize("line,expected", LINES)
def test_reports(spark, line, expected):
    df = spark.createDataFrame([(line,)], "metar string")
    got = reports.add_report_columns(df, "metar").first()
    assert tuple(got[n] for n in [*reports.NUMERIC_FIELDS, *reports.TEXT_FIELDS, "parse_ok"]) == expected


def test_buckets_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select("id", text.stable_bucket(F.col("id"), 42, 10).alias("b"))
    again = spark.range(1000).repartition(7).select("id", text.stable_bucket(F.col("id"), 42, 10).alias("b"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, again.collect()))
    assert {r["b"] for r in df.collect()} == set(range(10))
