"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# A key with more rows than this is spread over several tasks.
ROWS_PER_TASK = 5_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_task: int | None = None) -> DataFrame | None:
    """All keys above the limit with their row counts, as a written table, or None if there are none."""
    limit = rows_per_task or ROWS_PER_TASK
    counts = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit))
    return None if counts.isEmpty() else counts


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where NULL meets NULL; the right key columns are dropped."""
    names = {k: f"_right_{k}" for k in keys}
    same = F.lit(True)
    for key, other in names.items():
        same = same & F.col(key).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def collapse_copies(df: DataFrame, weight: str = "_copies") -> DataFrame:
    """Equal rows become one row with a count, so that a pile of copies weighs one row."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(weight))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    rows_per_task: int | None = None,
    hot: DataFrame | None | str = "count",
) -> DataFrame:
    """Equi-join in which the rows of a hot left key are dealt to several tasks.

    Without ``rows_per_task`` and ``hot`` this is a plain join, whose skewed partitions adaptive execution
    splits as it runs; nothing is counted beforehand. With either, the left row picks one of
    ``n`` slices from a hash of its own content and the right rows of that key are repeated once
    per slice, so each pair still meets exactly once, also where an aggregation above the
    join keeps Spark from splitting. Works for inner, left and left_semi joins. Left rows should not be
    plain copies of each other (see collapse_copies), otherwise they share a slice. ``hot``
    takes the result of an earlier hot_keys on the same left side.
    """
    limit = rows_per_task or ROWS_PER_TASK
    if isinstance(hot, str):
        hot = hot_keys(left, keys, limit) if rows_per_task else None
    if hot is None:
        return left.join(right, list(keys), how)
    dealt, repeated = deal(left, right, keys, hot, limit)
    return dealt.join(repeated, [*keys, "_slice"], how).drop("_slice")


def deal(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None, rows_per_task: int | None = None):
    """Both sides with a column ``_slice``: left rows of a hot key are dealt to its slices, right rows stand in each; 0 for other keys."""
    if hot is None:
        return left.withColumn("_slice", F.lit(0)), right.withColumn("_slice", F.lit(0))
    plan = hot.withColumn("_slices", F.ceil(F.col("_rows") / F.lit(rows_per_task or ROWS_PER_TASK)).cast("int")).drop("_rows")
    slices = F.coalesce("_slices", F.lit(1))
    dealt = null_safe_join(left, plan, keys, "left").select(
        *left.columns, F.pmod(F.xxhash64(*left.columns), slices).cast("int").alias("_slice")
    )
    repeated = null_safe_join(right, plan, keys, "left").select(
        *right.columns, F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice")
    )
    return dealt, repeated
