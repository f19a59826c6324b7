import json

import pytest
from pyspark.sql import functions as F

from flightloom.operators.validate import day_gaps
from flightloom.sources import readers, schemas, sinks

from .conftest import rows


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 1.0, 10.0, 20.0, 1000)], schemas.CAT62)
    path = str(tmp_path / "cat")
    sinks.write_csv(df, path)
    assert rows(readers.read_csv(spark, path, schemas.CAT62)) == rows(df)
    assert readers.read_csv(spark, path).schema["lat"].dataType.simpleString() == "string"
    with pytest.raises(Exception):
        sinks.write_csv(df, path)
    sinks.write_csv(df, path, mode="overwrite", single_file=True)
    assert len([p for p in (tmp_path / "cat").iterdir() if p.suffix == ".csv"]) == 1


def test_semicolon_csv_and_several_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("flightid;path\nf;p\n")
    (tmp_path / "b.csv").write_text("flightid;path\ng;q\n")
    got = readers.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "flightid string, path string", ";")
    assert rows(got) == [("f", "p"), ("g", "q")]


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hora,esperas,aero,more\n5,2.5,SBGR,x\n6,?,SBRJ,y\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), "hora long, aero string, esperas double")
    assert rows(got) == [(5, "SBGR", 2.5), (6, "SBRJ", None)]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "a.csv"), "hora long, troca double")
    (tmp_path / "b.csv").write_text("aero,hora,esperas,more\nSBSP,7,1.0,z\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], "hora long, aero string, esperas double").collect()


def test_json_by_name(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"aero": "SBGR", "hora": 5}, {"hora": 6, "aero": "SBRJ", "more": 1}]))
    assert rows(readers.read_json(spark, str(tmp_path), "hora long, aero string")) == [(5, "SBGR"), (6, "SBRJ")]


def test_documents_and_index(spark, tmp_path):
    (tmp_path / "a.jpg").write_text("[[[[1,2]]]]\n")
    assert rows(readers.read_documents(spark, str(tmp_path))) == [("a.jpg", "[[[[1,2]]]]")]
    assert rows(readers.image_index(spark, str(tmp_path)), "data", "tamanho") == [("a.jpg", 12)]


def test_pruned_scan_is_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", (F.col("id") * 2).alias("b"), F.lit("x").alias("c")).write.parquet(path)
    df = readers.read_columns(spark, path, ["id"], F.col("b") > 10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(b,10)" in plan and "c#" not in plan.split("ReadSchema")[0].split("FileScan")[1]
    assert df.count() == 4


def test_day_windows_and_gaps(spark):
    days = readers.day_windows(spark, "2024-02-28", "2024-03-01")
    assert [str(r["fdate"]) for r in days.orderBy("idate").collect()] == ["2024-02-29", "2024-03-01", "2024-03-02"]
    seen = spark.createDataFrame([("2024-02-29 10:00:00",)], "t string").withColumn("t", F.to_timestamp("t"))
    assert [str(r["idate"]) for r in day_gaps(seen, "t", days).orderBy("idate").collect()] == ["2024-02-28", "2024-03-01"]


def test_tracks_by_day_and_dictionary(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5, 1.0, 10.0, 20.0, 1000), ("a", 0.5, 1.0, 10.0, 20.0, 90_000_000)], schemas.CAT62)
    sinks.write_tracks(df, str(tmp_path / "t"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("dia")) == ["dia=1970-01-01", "dia=1970-01-02"]
    codes = spark.createDataFrame([("SBGR", 0)], "value string, code int")
    sinks.write_dictionary(codes, str(tmp_path / "d"))
    assert rows(spark.read.parquet(str(tmp_path / "d"))) == [("SBGR", 0)]


def test_contract_has_seventy_three_columns():
    assert len(schemas.FEATURES) == len(set(schemas.FEATURES)) == 73


def test_csv_types_from_all_rows(spark, tmp_path):
    lines = "\n".join(f"{i},{i / 2},{'x' if i == 499 else i}" for i in range(500))
    (tmp_path / "a.csv").write_text(f"n,half,mixed\n{lines}\n")
    got = readers.read_csv(spark, str(tmp_path / "a.csv"), infer=True)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "double", "string"] and got.count() == 500


def test_one_csv_file_has_all_rows_in_order(spark, tmp_path):
    path = str(tmp_path / "one")
    df = spark.range(5000, numPartitions=7).withColumn("a,b", F.concat(F.lit('say "x", '), F.col("id").cast("string")))
    sinks.write_csv(df, path, single_file=True)
    back = readers.read_csv(spark, path)
    assert back.columns == ["id", "a,b"] and len(back.inputFiles()) == 1
    assert [int(r[0]) for r in back.collect()] == list(range(5000))
    assert [p.name for p in tmp_path.iterdir()] == ["one"]
    with pytest.raises(ValueError, match="there already"):
        sinks.write_csv(df, path, single_file=True)
    sinks.write_csv(df.limit(0), path, mode="overwrite", single_file=True)
    assert readers.read_csv(spark, path).count() == 0 and readers.read_csv(spark, path).columns == ["id", "a,b"]
