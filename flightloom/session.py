"""Session defaults and the one way this package cuts lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even when the aggregate above it then needs its own shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Small but compute-heavy inputs (geometry joins) keep several tasks; large ones are not affected.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # The JVM never compiles larger methods: wide rows would go through its interpreter, about ten times slower than without whole-stage code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "flightloom", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set the defaults that may change on a running session."""
    for key, value in DEFAULTS.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that the driver and all executors reach.

    ``spark.checkpoint.dir`` of the session; where it is unset, a folder beside the
    session's own tables.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/checkpoints")
    return sc.getCheckpointDir()


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table of ``cut_lineage`` after its last reader has run."""
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/table-" in path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read on from there.

    Used where later steps must see the very same rows even if an executor is lost
    (row numbers that depend on partitioning) or where a loop would grow the plan. A
    written table also gives the planner true sizes for the joins that follow.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
