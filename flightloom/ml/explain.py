"""Contributions of features to predictions of a linear model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import mean_abs_ranking


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], means: Mapping[str, float]) -> DataFrame:
    """Per row and feature ``coefficient · (value − mean)``, in columns named like the features."""
    return df.select(
        *[(F.lit(float(c)) * (F.col(f"`{f}`") - F.lit(float(means[f])))).alias(f) for f, c in coefficients.items()]
    )


def top_contributions(contributions: DataFrame, features: Sequence[str], k: int = 15) -> DataFrame:
    return mean_abs_ranking(contributions, features, k)
