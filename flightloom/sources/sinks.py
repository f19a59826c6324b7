"""Writing results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPY_BYTES = 8 << 20


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False) -> None:
    """Headered CSV. With ``single_file`` the folder gets one file, its rows in the order of ``df``'s partitions."""
    if single_file:
        _write_one_csv(df, path, mode)
    else:
        df.write.mode(mode).option("header", True).csv(path)


def _header(names: list[str]) -> bytes:
    quoted = [f'"{n}"' if any(c in n for c in ",\n\r") else n for n in names]
    return (",".join(quoted) + "\n").encode()


def _write_one_csv(df: DataFrame, path: str, mode: str) -> None:
    """All tasks write their rows as text; one task then copies the bytes of the parts behind each other, a few megabytes at a time."""
    if any('"' in c for c in df.columns):
        raise ValueError("a column name with a quotation mark")
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(where):
        if mode == "ignore":
            return
        if mode != "overwrite":
            raise ValueError(f"{path} is there already")
    name = uuid.uuid4().hex
    whole, folder = store.makeQualified(where).toString(), spark._jvm.org.apache.hadoop.fs.Path(f"{path}-parts-{name}")
    df.write.option("header", False).csv(folder.toString())
    parts = sorted(f.getPath().toString() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    header, columns = _header(df.columns), "file string"

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            here, target = arrow_fs.FileSystem.from_uri(f"{whole}-new-{name}/part-00000-{name}.csv")
            here.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with here.open_output_stream(target) as out:
                out.write(header)
                for part in parts:
                    source, place = arrow_fs.FileSystem.from_uri(part)
                    with source.open_input_stream(place) as file:
                        while data := file.read(COPY_BYTES):
                            out.write(data)
            yield pa.RecordBatch.from_arrays([pa.array([target])], names=["file"])

    spark.range(1, numPartitions=1).mapInArrow(copy, columns).collect()  # the name of one file
    store.delete(where, True)
    store.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{path}-new-{name}"), where)
    store.delete(folder, True)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_tracks(points: DataFrame, path: str, mode: str = "errorifexists", slices: int = 16) -> None:
    """Tracks by day, so that later reads of a few days skip the other folders.

    Rows are brought together by day and hash slice first: a day gets at most ``slices`` files
    instead of one from every task, and its flights stay together in them.
    """
    dated = points.withColumn("dia", F.to_date(F.timestamp_millis("dt_radar")))
    slice_ = F.pmod(F.xxhash64("flightid"), F.lit(slices))
    write_parquet(dated.repartition("dia", slice_), path, ("dia",), mode)


def write_dictionary(dictionary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(value, code) table for later encoding."""
    dictionary.select("value", "code").write.mode(mode).parquet(path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    """Register for SQL text and hand back the same frame."""
    df.createOrReplaceTempView(name)
    return df
