"""Reading source files with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, sep: str = ",", infer: bool = False) -> DataFrame:
    """Headered CSV. With a schema the columns are found by name, whatever their order; without one all are text, or with
    ``infer`` of the narrowest type that all of their cells have, which takes one more pass over all rows.

    A column that the header lacks is an error, and so is a file whose header differs from that of the first one.
    Columns beyond the schema are not returned. A cell that is not of its type is NULL.
    """
    paths = path if isinstance(path, str) else list(path)
    reader = spark.read.option("header", True).option("sep", sep)
    if not schema:
        return reader.option("inferSchema", infer).option("samplingRatio", 1.0).csv(paths)
    wanted = StructType.fromDDL(schema)
    there = reader.csv(paths).columns
    missing = [f.name for f in wanted if f.name not in there]
    if missing:
        raise ValueError(f"columns {missing} are not in the header {there}")
    types = {f.name: f.dataType for f in wanted}
    by_header = StructType([StructField(name, types.get(name, StringType())) for name in there])
    return reader.schema(by_header).option("enforceSchema", False).csv(paths).select(*wanted.names)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that each hold an array of records; columns are found by name."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str], where: Column | None = None) -> DataFrame:
    """Parquet with only the columns and rows asked for; both reach the scan."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: file name and whole content."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("data"), F.col("value").alias("json"))


def image_index(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Catalogue of image files; the file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("data"), "path", F.col("length").alias("tamanho"), "modificationTime"
    )


def day_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day with the half-open request window [idate, fdate)."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias("idate")
    )
    return days.withColumn("fdate", F.date_add("idate", 1))
