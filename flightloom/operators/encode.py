"""Codes, dummies and scaling, fitted on one table and applied to another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import safe_name
from .positions import position_in_group


def label_dictionaries(
    df: DataFrame, columns: Sequence[str], order: Column | str, rows_per_task: int | None = None
) -> DataFrame:
    """(column, value, code): codes 0, 1, … per column in order of first appearance, from one scan."""
    at = F.col(order) if isinstance(order, str) else order
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), at.alias("_at")) for c in columns
    ]
    rows = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where(F.col("value").isNotNull())
    first = rows.groupBy("column", "value").agg(F.min("_at").alias("_first"))
    placed = position_in_group(first, ["column"], ["_first", "value"], "code", rows_per_task)
    return placed.select("column", "value", F.col("code").cast("int").alias("code"))


def label_dictionary(df: DataFrame, column: str, order: Column | str, rows_per_task: int | None = None) -> DataFrame:
    """(value, code) of one column."""
    return label_dictionaries(df, [column], order, rows_per_task).select("value", "code")


def encode(df: DataFrame, column: str, dictionary: DataFrame, unknown: int | None = -1) -> DataFrame:
    """Replace a column by its code. NULL or unknown values get ``unknown``."""
    entry = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    out = df.join(entry, F.col(column) == F.col("_value"), "left")
    code = F.col("_code") if unknown is None else F.coalesce("_code", F.lit(unknown))
    return out.select(*[code.alias(column) if c == column else F.col(f"`{c}`") for c in df.columns])


def decode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Replace a code by its value, NULL for codes the dictionary lacks."""
    entry = dictionary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    out = df.join(entry, F.col(column) == F.col("_code"), "left")
    return out.select(*[F.col("_value").alias(column) if c == column else F.col(f"`{c}`") for c in df.columns])


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """One row of distinct non-null counts."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(f"`{c}`")).alias(c) for c in columns])


def _few_levels(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, list]:
    """The levels of each column that has at most ``most`` of them, in order.

    A sketch of all columns rules out the others in one pass: with so few values it is off by much less than one. The levels of the
    columns that are left come from one more job; columns with more levels than that leave it before the driver sees them.
    """
    sketch = distinct_counts(df, columns, approximate=True).first()
    left = [c for c in columns if sketch[c] <= most + 1]
    if not left:
        return {}
    cells = [F.struct(F.lit(i).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(left)]
    levels = df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*").where("value IS NOT NULL").distinct()
    few = levels.groupBy("column").agg(F.collect_set("value").alias("values")).where(F.size("values") <= most)
    found = {r["column"]: sorted(r["values"]) for r in few.collect()}  # at most ``most`` values for each column
    return {c: found.get(i, []) for i, c in enumerate(left) if i in found or sketch[c] == 0}


def low_cardinality(df: DataFrame, columns: Sequence[str], most: int = 4) -> list[str]:
    """The columns with at most ``most`` distinct non-null values."""
    few = _few_levels(df, columns, most)
    return [c for c in columns if c in few]


def one_hot(df: DataFrame, columns: Sequence[str], most: int = 4) -> DataFrame:
    """Replace each column with at most ``most`` levels by 0/1 columns ``<column>_<level>``; a column with more is an error."""
    few = _few_levels(df, columns, most)
    out = df
    for column in columns:
        if column not in few:
            raise ValueError(f"{column} has more than {most} levels")
        for level in few[column]:
            hit = F.when(F.col(f"`{column}`").cast("string") == F.lit(level), 1).otherwise(0)
            out = out.withColumn(f"{column}_{safe_name(level)}", hit)
        out = out.drop(column)
    return out


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column from one pass; no spread counts as 1."""
    stats = []
    for i, c in enumerate(columns):
        stats += [F.avg(F.col(f"`{c}`")).alias(f"m{i}"), F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}")]
    row = df.agg(*stats).first()
    return {c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(f"`{c}`") - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})
