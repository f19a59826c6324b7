"""Checks that come back as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import flag


def contract_differences(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """(column, problem): contract columns that are missing and columns the contract lacks."""
    missing = [(c, "missing") for c in contract if c not in df.columns]
    extra = [(c, "extra") for c in df.columns if c not in contract]
    return df.sparkSession.createDataFrame(missing + extra, "column string, problem string")


def contract_report(df: DataFrame, contract: Sequence[str], numeric: Sequence[str] = ()) -> DataFrame:
    """(column, problem, rows, nulls) of every column of the contract and of ``df``.

    The problem is ``missing``, ``extra``, ``type`` (a column of ``numeric`` that holds no numbers) or ``ok``. Rows and NULL
    counts come from one aggregate over the data; a missing column has 0 of both.
    """
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)])
    kinds = dict(df.dtypes)
    cells = []
    for name in [*contract, *(c for c in df.columns if c not in contract)]:
        there = name in kinds
        text = there and name in numeric and kinds[name] in ("string", "binary", "boolean")
        problem = "missing" if not there else "extra" if name not in contract else "type" if text else "ok"
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(problem).alias("problem"),
                (F.col("rows") if there else F.lit(0).cast("long")).alias("rows"),
                (F.col(f"n{df.columns.index(name)}") if there else F.lit(0).cast("long")).alias("nulls"),
            )
        )
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; a left join to ``df`` on them would add rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, or an error naming the first repeated key."""
    row = repeated_keys(df, keys).limit(1).collect()
    if row:
        raise ValueError(f"{list(keys)} is not unique: {row[0].asDict()}")
    return df


def agreement(df: DataFrame, left: str, right: str, name: str = "eqq") -> DataFrame:
    """Rows per value of the 0/1 flag ``left = right``."""
    return df.groupBy(flag(F.col(left) == F.col(right)).alias(name)).agg(F.count(F.lit(1)).alias("rows"))


def day_gaps(df: DataFrame, time: str, days: DataFrame) -> DataFrame:
    """Days of the calendar on which ``df`` has no row."""
    seen = df.select(F.to_date(time).alias("idate")).distinct()
    return days.join(seen, "idate", "left_anti")
