"""Joins in the shapes the feature tables need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import skew_join


def attach(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str] | None = None,
    suffix: str = "_y",
    null_safe: bool = False,
) -> DataFrame:
    """Left join to a table that is unique on its key. The right key columns are dropped and
    right columns whose names are taken get the suffix.

    No broadcast hint: Spark broadcasts a right side it has measured to be small and
    sort-merges otherwise, with skewed left partitions split.
    """
    right_on = list(right_on or left_on)
    keys = [f"_key{i}" for i in range(len(right_on))]
    names = {c: (c + suffix if c in left.columns else c) for c in right.columns if c not in right_on}
    side = right.select(
        *[F.col(f"`{c}`").alias(k) for c, k in zip(right_on, keys)],
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
    )
    on = F.lit(True)
    for a, k in zip(left_on, keys):
        on = on & (F.col(a).eqNullSafe(F.col(k)) if null_safe else F.col(a) == F.col(k))
    return left.join(side, on, "left").drop(*keys)


def both_suffixes(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on shared keys; other shared names become ``_x`` (left) and ``_y`` (right)."""
    shared = (set(left.columns) & set(right.columns)) - set(keys)
    a = left.withColumnsRenamed({c: c + "_x" for c in shared})
    b = right.withColumnsRenamed({c: c + "_y" for c in shared})
    return a.join(b, list(keys), how)


def keep_members(
    df: DataFrame,
    members: DataFrame,
    keys: Sequence[str],
    rows_per_task: int | None = None,
    hot: DataFrame | None | str = "count",
) -> DataFrame:
    """Rows whose key is in ``members`` (semi-join), balanced when one key is very frequent."""
    return skew_join(df, members.select(*keys), keys, "left_semi", rows_per_task, hot)


def look_up(df: DataFrame, column: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """Replace a column by its dictionary value; NULL when the dictionary has no entry."""
    entry = table.select(F.col(source).alias("_source"), F.col(target).alias("_target"))
    out = df.join(entry, F.col(column) == F.col("_source"), "left")
    return out.select(*[F.col("_target").alias(column) if c == column else F.col(f"`{c}`") for c in df.columns])
