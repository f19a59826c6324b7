"""Row positions and running totals inside groups of any size, and exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .skew import hot_keys, null_safe_join

# monotonically_increasing_id keeps the partition number above this many bits.
_ROW_BITS = 33


def _sorted_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Range-partition and sort on (keys, order), number the rows, and fix that numbering."""
    spread = [F.col(k) for k in keys] + list(order)
    ranged = df.repartitionByRange(*spread).sortWithinPartitions(*spread)
    ranged = ranged.withColumn("_row", F.monotonically_increasing_id())
    return cut_lineage(ranged).withColumn("_range", F.shiftright("_row", _ROW_BITS))


def _before_range(ranged: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """Per (range, key): total of the key in earlier ranges, and the first row number.

    One row per range plus one per key.
    """
    sums = ranged.groupBy("_range", *keys).agg(size.alias("_size"), F.min("_row").alias("_start"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", *keys, "_start", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))


def _spread_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    ranged = _sorted_ranges(df, keys, order)
    before = _before_range(ranged, keys, F.count(F.lit(1)))
    joined = null_safe_join(ranged, before, ["_range", *keys])
    return joined.select(*df.columns, (F.col("_row") - F.col("_start") + F.col("_before")).alias(name))


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    name: str = "position",
    rows_per_task: int | None = None,
    hot: DataFrame | None | str = "count",
) -> DataFrame:
    """Add the 0-based position of each row in its group, in the given (total) order.

    Groups that fit into one task use a plain window. Larger ones, and the case of no
    keys at all, are range-partitioned on the order itself, so their rows lie in many
    tasks; the offset of each range is then added.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if not keys:
        return _spread_positions(df, [], order, name)
    window = Window.partitionBy(*keys).orderBy(*order)
    if isinstance(hot, str):
        hot = hot_keys(df, keys, rows_per_task)
    if hot is None:
        return df.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    hot = hot.drop("_rows")
    calm = null_safe_join(df, hot, keys, "left_anti")
    calm = calm.withColumn(name, (F.row_number().over(window) - 1).cast("long"))
    return calm.unionByName(_spread_positions(null_safe_join(df, hot, keys, "left_semi"), keys, order, name))


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: str, name: str
) -> DataFrame:
    """Add the total weight of the earlier rows of the group, without a group in one task.

    Meant for few groups with many rows each (such as one group per column).
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = _sorted_ranges(df, keys, order)
    before = _before_range(ranged, keys, F.sum(weight))
    inside = Window.partitionBy("_range", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    part = ranged.withColumn("_part", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    joined = null_safe_join(part, before, ["_range", *keys])
    return joined.select(*df.columns, (F.col("_part") + F.col("_before")).alias(name))


def long_form(df: DataFrame, columns: Sequence[str], name: str = "column", value: str = "value") -> DataFrame:
    """One (column, value) row per cell of the given numeric columns."""
    cells = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("double").alias(value)) for c in columns]
    return df.select(F.explode(F.array(*cells)).alias("_cell")).select(f"_cell.{name}", f"_cell.{value}")


def value_counts(cells: DataFrame, name: str = "column", value: str = "value") -> DataFrame:
    """Rows per distinct non-null value of each column."""
    present = cells.where(F.col(value).isNotNull() & ~F.isnan(value))
    return present.groupBy(name, value).agg(F.count(F.lit(1)).alias("rows"))


def exact_percentiles(counts: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(column, probability, percentile) with linear interpolation, from value counts."""
    placed = running_total(counts, ["column"], ["value"], "rows", "_before")
    sizes = counts.groupBy("column").agg(F.sum("rows").alias("_n"))
    # One row per column and probability.
    wanted = sizes.withColumn("probability", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
    rank = (F.col("_n") - 1) * F.col("probability")
    wanted = F.broadcast(wanted.select("column", "probability", rank.alias("_rank")))
    low, high = F.floor("_rank"), F.ceil("_rank")
    last = F.col("_before") + F.col("rows") - 1
    near = placed.join(wanted, "column").where((last >= low) & (F.col("_before") <= high))
    holds_low = (F.col("_before") <= low) & (low <= last)
    holds_high = (F.col("_before") <= high) & (high <= last)
    ends = near.groupBy("column", "probability", "_rank").agg(
        F.max(F.when(holds_low, F.col("value"))).alias("_low"),
        F.max(F.when(holds_high, F.col("value"))).alias("_high"),
    )
    share = F.col("_rank") - F.floor("_rank")
    return ends.select(
        "column", "probability", (F.col("_low") + (F.col("_high") - F.col("_low")) * share).alias("percentile")
    )
