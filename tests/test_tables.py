import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from flightloom.functions.text import clean_names
from flightloom.operators import calendars, clean, encode, flights, joins, stats, tracks, validate, weather

from .conftest import rows

POINTS = "flightid string, lat double, lon double, flightlevel double, speed double, dt_radar long"


@pytest.fixture(scope="module")
def small(spark):
    data = [
        ("a", 0.0, 1.0, 30.0, 300.0, 3000),
        ("a", 0.0, 0.0, 10.0, 100.0, 1000),
        ("a", 5.0, 5.0, 20.0, 200.0, 2000),
        ("b", 1.0, 1.0, 7.0, 70.0, 500),
        (None, 9.0, 9.0, 9.0, 9.0, 9),
    ]
    return spark.createDataFrame(data, POINTS)


def test_track_summary(small):
    got = {r["flightid"]: r.asDict() for r in tracks.track_summary(small).collect()}
    assert set(got) == {"a", "b"}
    a, b = got["a"], got["b"]
    assert (a["duration"], a["lon_first"], a["lon_last"], a["flightlevel_std"]) == (2.0, 0.0, 1.0, 10.0)
    assert a["distancia"] == pytest.approx(111.194927, abs=1e-6)
    assert (b["duration"], b["flightlevel_std"], b["distancia"]) == (0.0, None, 0.0)


def test_track_summary_is_one_hash_aggregation(small):
    plan = tracks.track_summary(small)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1


def test_every_nth(spark):
    data = [("f", float(i), 0.0, 0.0, 0.0, i) for i in range(9)] + [("g", 0.0, 0.0, 0.0, 0.0, 5)]
    df = spark.createDataFrame(data, POINTS)
    for limit in (None, 3):
        got = tracks.every_nth(df, 7, rows_per_task=limit)
        assert rows(got, "flightid", "dt_radar") == [("f", 0), ("f", 7), ("g", 5)]


@pytest.mark.parametrize("limit", [None, 1])
def test_realign(spark, small, limit):
    new = spark.createDataFrame([("a", 10_000)], "flightid string, dt_dep long")
    got = tracks.realign(small, new, limit)
    assert rows(got, "flightid", "dt_radar") == [("a", 10_000), ("a", 11_000), ("a", 12_000)]


def test_first_value_skips_missing(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5.0, 2), ("a", 6.0, 3)], "flightid string, v double, dt_radar long")
    assert {r["first"] for r in tracks.with_first_value(df, "v", "first").collect()} == {5.0}


def test_typical_flight(spark):
    data = [("r", "x", 10.0), ("r", "y", 20.0), ("r", "z", 90.0), ("s", "only", 5.0), ("t", "b", 1.0), ("t", "a", 3.0)]
    df = spark.createDataFrame(data, "linha string, flightid string, flight_time double")
    # s has one flight and so no spread; in t both are equally far from the mean
    assert rows(tracks.typical_flight(df)) == [("r", "y"), ("t", "a")]


def test_flights(spark):
    data = [("f", "SBGR", "SBRJ", 2500, 1000), ("f", "SBGR", "SBRJ", 9000, 9999), ("g", None, "SBRJ", 0, 1500)]
    df = spark.createDataFrame(data, "flightid string, origem string, destino string, dt_dep long, dt_arr long")
    got = {r["flightid"]: r for r in flights.prepare_flights(df).collect()}
    assert (got["f"]["target"], got["f"]["linha"]) == (-2, "SBGRSBRJ")
    assert (got["g"]["target"], got["g"]["linha"], got["g"]["diaSemana"]) == (1, None, 3)


def hour_tables(spark):
    at = 1_704_067_200_000
    flight = [("f1", "SBGR", at), ("f2", "SBRJ", at + 7_200_000)]
    held = [(at + 60_000, "SBGR", 2.0), (at + 120_000, "SBRJ", 3.0), (at + 3_600_000, "SBGR", None)]
    f = spark.createDataFrame(flight, "flightid string, origem string, ms long")
    f = f.withColumn("dep_hour", F.date_trunc("hour", F.timestamp_millis("ms")))
    return f, calendars.with_calendar(spark.createDataFrame(held, "hora long, aero string, esperas double"))


def test_bucket_sums_and_counts(spark):
    f, h = hour_tables(spark)
    assert rows(calendars.bucket_sum(f, h, "esperas", "e"), "flightid", "e") == [("f1", 5.0), ("f2", 0.0)]
    by = dict(flight_keys=["dep_hour", "origem"], row_keys=["hour_ts", "aero"])
    assert rows(calendars.bucket_sum(f, h, "esperas", "e", **by), "flightid", "e") == [("f1", 2.0), ("f2", 0.0)]
    assert rows(calendars.bucket_count(f, h, "n"), "flightid", "n") == [("f1", 2), ("f2", 0)]
    assert rows(calendars.bucket_count(f, h, "n", at_least=1), "flightid", "n") == [("f1", 2), ("f2", 1)]


def test_profiles_agree_with_grouping_sets(spark):
    _, h = hour_tables(spark)
    measures = calendars.mean_and_sum("esperas")
    sets = calendars.profile_sets(h, measures)
    for level, table in calendars.profiles(h, measures).items():
        names = table.columns
        assert rows(sets.where(F.col("level") == level), *names) == rows(table)


def test_sum_of_nothing_known_is_zero(spark):
    df = spark.createDataFrame([("a", None)], "aero string, esperas double")
    got = calendars.profile_by(df, ["aero"], calendars.mean_and_sum("esperas")).first()
    assert (got["mean"], got["sum"]) == (None, 0.0)


def test_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    assert rows(joins.attach(left, right, ["k"]), "v", "v_y") == [(1, None), (2, 20)]
    assert rows(joins.attach(left, right, ["k"], null_safe=True), "v", "v_y") == [(1, 10), (2, 20)]


def test_look_up_and_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "i int, c string")
    codes = encode.label_dictionary(df, "c", "i")
    assert rows(codes) == [("a", 1), ("b", 0)]
    coded = encode.encode(df, "c", codes)
    assert [r["c"] for r in coded.orderBy("i").collect()] == [0, 1, -1, 0]
    back = encode.decode(coded, "c", codes)
    assert [r["c"] for r in back.orderBy("i").collect()] == ["b", "a", None, "b"]
    assert list(pd.factorize(pd.Series(["b", "a", None, "b"]))[0]) == [0, 1, -1, 0]


def test_one_hot_and_limit(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, c string")
    assert rows(encode.one_hot(df, ["c"])) == [(1, 1, 0), (2, 0, 1), (3, 0, 0)]
    with pytest.raises(ValueError):
        encode.one_hot(spark.range(9), ["id"])
    assert encode.low_cardinality(df, ["i", "c"], 2) == ["c"]


def test_standardise_constant_and_missing(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    out = encode.standardise(df, encode.scaling(df, ["a", "b"]))
    assert rows(out) == sorted([(-1.0, 0.0), (1.0, 0.0), (None, 0.0)], key=repr)


def test_clean(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "stop")], "i int, t string")
    assert rows(clean.keep_except(df, "t", "stop"), "i") == [(1,), (2,)]
    assert clean_names(spark.range(1).toDF("['a.b'],<c>")).columns == ["abc"]
    assert clean.numbered_repeats(["a", "a", "b", "a"]) == ["a", "a1", "b", "a2"]
    filled = clean.with_missing_flags(spark.createDataFrame([(None,), (2.0,)], "v double"), ["v"])
    assert rows(filled) == [(-99.0, 1), (2.0, 0)]
    both = clean.append(df, spark.createDataFrame([(9,)], "i int"))
    assert (9, None) in rows(both)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 5, None)], "k string, o int, v string")
    assert rows(clean.first_per_key(df, ["k"], ["o"])) == [("a", 1, "early"), ("b", 5, None)]


def test_validation(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k int, v int")
    assert rows(validate.repeated_keys(df, ["k"])) == [(1, 2)]
    with pytest.raises(ValueError):
        validate.require_unique(df, ["k"])
    assert validate.require_unique(df, ["k", "v"]) is df
    assert rows(validate.contract_differences(df, ["k", "z"])) == [("v", "extra"), ("z", "missing")]
    assert rows(validate.agreement(df, "k", "v")) == [(0, 2), (1, 1)]


def test_weather_statistics(spark):
    at = 1_704_067_200_000
    data = [
        (at, "SBGR", "METAR SBGR 010000Z 09005KT 9999 20/10 Q1010="),
        (at + 60_000, "SBGR", "METAR SBGR 010001Z 09007KT 9999 24/10 Q1010="),
        (at + 90_000, "SBGR", "garbage"),
    ]
    parsed = weather.parse_reports(spark.createDataFrame(data, "hora long, aero string, metar string"), "metar")
    got = weather.hourly_weather(parsed).first()
    assert (got["Temperaturamean"], got["Temperaturamin"], got["Temperaturamax"]) == (22.0, 20.0, 24.0)
    assert got["Temperaturastd"] == pytest.approx(math.sqrt(8))
    assert weather.hourly_weather(parsed, fill=-99).first()["Temperaturamin"] == -99.0
    rate = weather.parse_rate(parsed).first()
    assert (rate["reports"], rate["parsed"]) == (3, 2)


def test_weather_join_equals_join_then_aggregate(spark):
    at = 1_704_067_200_000
    reports = [(at + i * 1000, "SBGR", f"METAR SBGR 010000Z 09005KT 9999 {20 + i}/10 Q1010=") for i in range(5)]
    hourly = weather.hourly_weather(weather.parse_reports(spark.createDataFrame(reports, "hora long, aero string, metar string"), "metar"))
    f = spark.createDataFrame([("f", "SBGR", at), ("g", "SBGR", at), ("h", "SBXX", at)], "flightid string, destino string, ms long")
    f = f.withColumn("arr_hour", F.date_trunc("hour", F.timestamp_millis("ms")))
    got = weather.attach_weather(f, hourly, "destino", "arr_hour", "_x")
    assert rows(got, "flightid", "Temperaturamean_x") == [("f", 22.0), ("g", 22.0), ("h", None)]


def test_describe_equals_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0, 8.0, None], "b": [5.0, 5.0, 5.0, 7.0, 1.0]})
    data = [(None if math.isnan(a) else a, b) for a, b in zip(pdf["a"], pdf["b"])]
    got = {r["column"]: r for r in stats.describe(spark.createDataFrame(data, "a double, b double"), ["a", "b"]).collect()}
    for c in ("a", "b"):
        want = pdf[c].describe()
        names = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
        assert [got[c][n] for n in names] == pytest.approx(list(want))


def test_correlations_leave_out_missing_pairs(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, None, 6], "b": [2, 4, 5, None, 1, 9], "c": [5, 3, 8, 1, 1, 2]}, dtype=float)
    data = [tuple(None if math.isnan(v) else v for v in row) for row in pdf.to_numpy().tolist()]
    df = spark.createDataFrame(data, "a double, b double, c double")
    want = pdf.corr()
    for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r["a"], r["b"]])


def test_prune_drops_copies(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"), (F.col("id") * 2).cast("double").alias("b"), (F.col("id") * 37 % 11).cast("double").alias("c")
    )
    kept = stats.prune_correlated(df, ["a", "b", "c"], 0.9)
    assert "c" in kept and len(kept) == 2


def test_sparsity_counts_missing_as_filled(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, None)], "a double, b double")
    assert stats.sparsity(df, ["a", "b"]).first()["sparsity"] == 0.5


@pytest.mark.parametrize("limit", [None, 2])
def test_swarm(spark, limit):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.04)], "i int, v double")
    got = stats.swarm_layout(df, "v", "i", rows_per_task=limit)
    assert [r["y"] for r in got.orderBy("i").collect()] == pytest.approx([-0.12, 0.12, -0.24])


def test_seeded_sample(spark):
    df = spark.range(500)
    one = rows(stats.seeded_sample(df, "id", 20))
    assert len(one) == 20 and one == rows(stats.seeded_sample(df.repartition(9), "id", 20))
    assert one != rows(stats.seeded_sample(df, "id", 20, seed=1))


def test_points_of_the_same_time_have_a_fixed_order(spark):
    data = [("a", float(i % 5), float(i), 1.0, 1.0, 1000) for i in range(20)]
    one = tracks.track_summary(spark.createDataFrame(data, POINTS)).first()
    two = tracks.track_summary(spark.createDataFrame(data[::-1], POINTS).repartition(7)).first()
    assert one == two


def test_near_ties_and_unknown_ends_of_a_track(spark):
    data = [("a", 1.0, 0.0, 1.0, 1.0, 1000), ("a", 0.0, 0.6, 1.0, 1.0, 1000), ("a", None, 0.3, 1.0, 1.0, 500), ("a", 5.0, None, 1.0, 1.0, 2000)]
    for order in (data, data[::-1]):
        got = tracks.track_summary(spark.createDataFrame(order, POINTS)).first()
        assert (got.lat_first, got.lat_last, got.lon_first, got.lon_last) == (0.0, 5.0, 0.3, 0.0)
    gone = tracks.track_summary(spark.createDataFrame([("b", None, None, 1.0, 1.0, 1000)], POINTS)).first()
    assert gone.lat_first is None and gone.distancia is None


def test_weather_blocks_stay_one_column_through_the_joins(spark):
    f = spark.createDataFrame([(1, "A", "B", 1), (2, "B", "C", 2), (3, None, "A", None)], "flightid long, o string, d string, h long")
    first = spark.createDataFrame([("A", 1, 1.0, None), ("B", 2, 2.0, 3.0)], "aero string, hour_ts long, t double, p double")
    second = spark.createDataFrame([("B", 1, 5.0, 6.0)], "aero string, hour_ts long, t double, p double")
    out = weather.attach_blocks(f, [(first, "o", "h", "_x"), (second, "d", "h", "_y")])
    assert out.columns == ["flightid", "o", "d", "h", "t_x", "p_x", "t_y", "p_y"]
    assert rows(out.drop("o", "d", "h")) == [(1, 1.0, None, 5.0, 6.0), (2, 2.0, 3.0, None, None), (3, None, None, None, None)]
    last = out._jdf.queryExecution().optimizedPlan().children().head()
    assert last.nodeName() == "Join"
    assert last.output().size() == len(f.columns) + 2 + 2  # two blocks and the two keys of the last one, no statistics by themselves


def test_methods_too_large_for_the_compiler_are_not_made(spark):
    from flightloom.session import tune

    assert int(tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
