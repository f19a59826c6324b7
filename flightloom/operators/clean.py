"""Projections, predicates and clean-up."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_except(df: DataFrame, column: str, sentinel: str) -> DataFrame:
    """Drop rows that carry the sentinel; NULL rows stay."""
    return df.where(~F.col(column).eqNullSafe(F.lit(sentinel)))


def between_times(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Half-open range [start, end) on a timestamp column, in the form scans can push down."""
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < F.lit(end).cast(kind)))


def keep_known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_numbers(df: DataFrame, value: float = -99, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(columns) if columns else None)


def with_missing_flags(df: DataFrame, columns: Sequence[str], value: float = -99) -> DataFrame:
    """Fill missing numbers and say in an extra 0/1 column that they were missing."""
    flags = {f"{c}_missing": F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in columns}
    return df.withColumns(flags).fillna(value, subset=list(columns))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The whole first row of each key, combined on the map side, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def rename_by_place(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def in_order(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in contract])


def append(*batches: DataFrame) -> DataFrame:
    """All rows of all batches, matched by name; a column missing in a batch is NULL there."""
    out = batches[0]
    for batch in batches[1:]:
        out = out.unionByName(batch, allowMissingColumns=True)
    return out


def numbered_repeats(names: Sequence[str]) -> list[str]:
    """Repeated names get 1, 2, … appended, the first keeps its name."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        count = seen.get(name, 0)
        out.append(f"{name}{count}" if count else name)
        seen[name] = count + 1
    return out


def several(columns: Sequence[str], functions: Mapping[str, object], sep: str = "_") -> list[Column]:
    """Aggregates with flat names ``<column><sep><function>``."""
    return [f(F.col(f"`{c}`")).alias(f"{c}{sep}{n}") for c in columns for n, f in functions.items()]


def safe_name(text: str) -> str:
    return re.sub(r"\W", "_", text)
