"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stable_bucket


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is NULL."""
    return F.when(condition, 1).otherwise(0)


def override(condition: Column, value: float, otherwise: Column) -> Column:
    return F.when(condition, F.lit(value)).otherwise(otherwise)


def clip_rescale(value: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high] and stretch to about [0, 1]."""
    clipped = F.when(value.isNull(), None).otherwise(F.greatest(F.least(value, high), low))
    return (clipped - low) / (high - low + F.lit(1e-9))


def bin_number(value: Column, width: float) -> Column:
    return F.floor(value / F.lit(width))


def abs_z(value: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; NULL when there is no spread."""
    return F.abs((value - mean) / F.nullif(std, F.lit(0.0)))


_JITTER_STEPS = 1_000_000


def jitter(key: Column, seed: int, half_width: float = 0.35) -> Column:
    """Repeatable offset in ±half_width that depends on the key only."""
    unit = stable_bucket(key, seed, _JITTER_STEPS) / F.lit(float(_JITTER_STEPS))
    return unit * F.lit(2 * half_width) - F.lit(half_width)


def side_of_stack(rank: Column, step: float = 0.12) -> Column:
    """Height of the rank-th mark of a bin: pairs of rows, odd ranks up, even ranks down."""
    level = (F.floor(rank / F.lit(2)) + F.lit(1)) * F.lit(step)
    return F.when(rank % 2 == 1, level).otherwise(-level)


def time_order(ms: Column, lat: Column, lon: Column) -> Column:
    """One decimal that sorts by time, then latitude, then longitude (degrees, to 1e-9); unknown ones come first.

    Fixed width, so that ``min_by`` with it stays a hash aggregation, and never the same for two places.
    """

    def part(degrees: Column, shift: float) -> Column:
        steps = F.pmod(F.round((degrees + F.lit(shift)) * F.lit(1e9)), F.lit(1e12))
        return F.coalesce(steps.try_cast("decimal(12,0)"), F.lit(0).cast("decimal(12,0)"))

    def power(n: int) -> Column:
        return F.lit("1" + "0" * n).cast(f"decimal({n + 1},0)")

    time = ms.cast("decimal(13,0)") * power(24)
    return (time + part(lat, 90.0) * power(12) + part(lon, 180.0)).cast("decimal(38,0)")
