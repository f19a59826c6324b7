"""Queries on sources, sinks and saved models: a table is written to the shared folder, read back, and compared with itself."""

from __future__ import annotations

import uuid

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from ..ml import models, prepare
from ..operators import encode
from ..session import shared_dir
from ..sources import readers, sinks
from . import standins as s
from .registry import Registry
from .standins import q, rounded, sql

REGISTRY = Registry()
_add = REGISTRY.add

_RECORDS_IN_FILE = 1000


def _folder(spark, name: str) -> str:
    """A new folder that the driver and all executors reach."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_MOVES = "SELECT flightid, origem, destino, dt_dep, dt_arr FROM movements"


@_add("csv_by_name", sql(_MOVES, "movements"))
def csv_by_name(spark, d):
    path = _folder(spark, "csv")
    moves = s.movements(spark, d)
    sinks.write_csv(moves.select(*reversed(moves.columns)), path)
    return readers.read_csv(spark, path, "flightid LONG, origem STRING, destino STRING, dt_dep LONG, dt_arr LONG")


@_add("csv_semicolon", sql("SELECT flightid, origem FROM movements", "movements"))
def csv_semicolon(spark, d):
    path = _folder(spark, "csv")
    s.movements(spark, d).select("flightid", "origem").write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, "flightid LONG, origem STRING", ";")


@_add("csv_as_text", sql("SELECT flightid::VARCHAR AS flightid, origem, dt_dep::VARCHAR AS dt_dep FROM movements", "movements"))
def csv_as_text(spark, d):
    path = _folder(spark, "csv")
    sinks.write_csv(s.movements(spark, d).select("flightid", "origem", "dt_dep"), path)
    return readers.read_csv(spark, path)


@_add("csv_inferred", sql("SELECT flightid, origem, dt_dep, CAST(dt_dep / 7 AS DOUBLE) AS part, CASE WHEN dt_dep % 3 = 0 THEN 'x' ELSE '12' END AS mixed FROM movements", "movements"))
def csv_inferred(spark, d):
    """Types from the cells of all rows: numbers, fractions, and text where any cell is text."""
    path = _folder(spark, "csv")
    moves = s.movements(spark, d).select("flightid", "origem", "dt_dep")
    mixed = F.when(F.col("dt_dep") % 3 == 0, "x").otherwise("12")
    sinks.write_csv(moves.withColumns({"part": F.col("dt_dep") / 7, "mixed": mixed}), path)
    return readers.read_csv(spark, path, infer=True)


@_add("csv_one_file", "SELECT o_orderkey, o_orderpriority, 1::BIGINT AS files FROM orders")
def csv_one_file(spark, d):
    path = _folder(spark, "csv")
    orders = s.read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    for _ in range(2):  # the second writing replaces the first
        sinks.write_csv(orders, path, mode="overwrite", single_file=True)
    back = readers.read_csv(spark, path, "o_orderkey LONG, o_orderpriority STRING")
    return back.withColumn("files", F.lit(len(back.inputFiles())).cast("long"))


@_add("folder_documents", "SELECT lang, text FROM documents WHERE text IS NOT NULL")
def folder_documents(spark, d):
    """Files of a folder with their names: each holds JSON lines of one language."""
    path = _folder(spark, "files")
    docs = s.read(spark, d, "documents").where("text IS NOT NULL").select("lang", "text")
    docs.select(F.to_json(F.struct("lang", "text")).alias("value")).write.option("maxRecordsPerFile", 1000).text(path)
    files = readers.read_documents(spark, path)
    named = readers.image_index(spark, path, "part-*").select("data", "tamanho")
    lines = files.join(named, "data").where("tamanho > 0").select(F.explode(F.split("json", "\n")).alias("line"))
    fields = F.from_json("line", "lang STRING, text STRING").alias("r")
    return lines.where("line <> ''").select(fields).select("r.lang", "r.text")


@_add("dictionary_table", sql("SELECT value, code FROM k", k="SELECT o_orderpriority AS value, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INT) AS code FROM orders GROUP BY 1"))
def dictionary_table(spark, d):
    path = _folder(spark, "dictionary")
    orders = s.read(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    sinks.write_dictionary(encode.label_dictionary(orders, "o_orderpriority", "o_orderkey"), path)
    return spark.read.parquet(path)


@_add("json_records", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def json_records(spark, d):
    """Files that each hold an array of records, with the fields in another order than the schema's."""
    path = _folder(spark, "json")
    customer = s.read(spark, d, "customer")
    files = customer.count() // _RECORDS_IN_FILE + 1
    customer = customer.withColumn("part", F.pmod(F.xxhash64("c_custkey"), F.lit(files)))
    records = F.collect_list(F.struct("c_nationkey", "c_name", "c_custkey"))  # about so many records, at any size of the table
    arrays = customer.groupBy("part").agg(F.to_json(records).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)
    return readers.read_json(spark, path, "c_custkey LONG, c_name STRING, c_nationkey INT").select("c_custkey", "c_name", "c_nationkey")


@_add("tracks_by_day", sql("SELECT flightid, dt_radar, lat, lon FROM points WHERE make_timestamp(dt_radar * 1000)::DATE = DATE '2024-01-15'", "points"))
def tracks_by_day(spark, d):
    path = _folder(spark, "tracks")
    sinks.write_tracks(s.points_degrees(spark, d), path)
    day = F.col("dia") == F.lit("2024-01-15").cast("date")
    return readers.read_columns(spark, path, ["flightid", "dt_radar", "lat", "lon"], day)


@_add(
    "saved_model",
    sql(f"SELECT l_orderkey, l_linenumber, {q('a + b * l_quantity', 4, 'prediction')} FROM lineitem, f", f="SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem"),
)
def saved_model(spark, d):
    path = _folder(spark, "model")
    lines = s.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("target"), "l_quantity")
    data = prepare.assemble(lines, ["l_quantity"])
    models.save(models.linear().fit(data), path)
    scored = models.load(LinearRegressionModel, path).transform(data)
    return rounded(scored.select("l_orderkey", "l_linenumber", "prediction"), 4)
