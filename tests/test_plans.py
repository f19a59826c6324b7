import pytest
from pyspark.sql import functions as F

from flightloom.plans import features, storms, synthetic
from flightloom.sources.schemas import FEATURES

from .conftest import rows

HOUR = 1_704_067_200_000


def test_most_exposed_flight_of_an_hour(spark):
    square = [(0, 7, k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])]
    vertices = spark.createDataFrame(square, "bucket int, poly int, vertice int, x double, y double")
    data = [
        ("a", HOUR, 5.0, 5.0), ("a", HOUR + 60_000, 20.0, 5.0), ("b", HOUR, 5.0, 5.0), ("b", HOUR + 1000, 6.0, 6.0),
        ("b", HOUR + 2000, 50.0, 6.0), ("c", HOUR + 3_600_000, 5.0, 5.0), ("c", HOUR + 3_600_001, 5.0, 5.0), ("c", HOUR + 3_600_002, 5.0, 5.0),
    ]
    points = spark.createDataFrame(data, "flightid string, ms long, lon double, lat double")
    points = points.select("flightid", F.timestamp_millis("ms").alias("dt_radar"), "lon", "lat", F.lit(0).alias("bucket"))
    best, shown = storms.most_exposed_flight(points, vertices, "2024-01-01 00:00:00")
    assert best == "b"
    assert [(r["inside"], r["is_start"], r["is_end"]) for r in shown.collect()] == [(1, 1, 0), (1, 0, 0), (0, 0, 1)]
    with pytest.raises(ValueError):
        storms.most_exposed_flight(points, vertices, "2030-01-01 00:00:00")


def test_synthetic_tracks_start_at_departure(spark):
    points = spark.createDataFrame(
        [("f", 1000 * i, float(i), 0.0) for i in range(9)] + [("g", 0, 0.0, 0.0), ("g", 90_000, 0.0, 0.0), ("h", 0, 0.0, 0.0), ("h", 9_000, 1.0, 1.0)],
        "flightid string, dt_radar long, lat double, lon double",
    )
    flights = spark.createDataFrame([("f", "AB"), ("g", "AB"), ("h", "AB")], "flightid string, linha string")
    kept = synthetic.representative_tracks(points, flights, 7)
    assert rows(kept, "linha", "flightid").count(("AB", "h")) == 1
    new = spark.createDataFrame([("n1", "AB", 500_000), ("n2", "XY", 1)], "flightid string, linha string, dt_dep long")
    got = rows(synthetic.synthetic_tracks(kept, new), "flightid", "dt_radar")
    assert ("n1", 500_000) in got and ("n2", None) in got


def test_training_and_scoring_have_the_same_columns_and_keep_rows(spark):
    text = "METAR SBBB 010000Z 09005KT 9999 20/10 Q1010="
    raw = spark.createDataFrame(
        [("f", "SBAA", "SBBB", HOUR, HOUR + 1_000_000), ("g", "SBAA", "SBBB", HOUR, HOUR + 2_000_000), ("h", "SBBB", None, HOUR, HOUR)],
        "flightid string, origem string, destino string, dt_dep long, dt_arr long",
    )
    points = spark.createDataFrame(
        [("f", 0.1, 0.2, 10.0, 5.0, HOUR), ("f", 0.2, 0.3, 20.0, 6.0, HOUR + 5000)],
        "flightid string, lat double, lon double, flightlevel double, speed double, dt_radar long",
    )
    held = spark.createDataFrame([(HOUR, "SBAA", 2.0)], "hora long, aero string, esperas double")
    report = spark.createDataFrame([(HOUR, "SBBB", text)], "hora long, aero string, metar string")
    change = spark.createDataFrame([(HOUR, "AA", 1.0)], "hora long, aero string, troca double")
    cells = spark.createDataFrame([(5.7, 11.5, 500.0)], "lat double, lon double, radius_km double")
    cells = cells.withColumn("hour_ts", F.timestamp_millis(F.lit(HOUR)))
    flights = features.flight_table(raw)
    tables = features.build_tables(
        flights, points, held, report, report.withColumnRenamed("metar", "metaf"), change, change.drop("troca"),
        storms.training_exposure(points, cells),
    )
    codes = features.dictionaries(flights)
    train = features.training_table(flights, tables, codes)
    assert train.columns == ["flightid", "target", *FEATURES] and train.count() == 3
    f = train.where("flightid = 'f'").first()
    assert (f["esperas"], f["troca"], f["Temperaturamean_x"], f["origem"], f["dt_radar_lambda"]) == (2.0, 1.0, 20.0, 0, 5.0)
    assert f["sum(flight_through_area)"] == 1  # the second point is some 890 km from the storm
    test_set = raw.withColumn("path", F.lit("http://img/S1_202401010010.jpg"))
    scored = features.scoring_table(test_set, tables, codes)
    assert scored.columns == ["flightid", *FEATURES] and scored.count() == 3
    assert features.training_table(flights, tables, codes, longer_than=1500).count() == 1
