"""From feature tables to vectors, splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_bucket


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Feature columns to one vector column; fill missing numbers first."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="keep").transform(df)


def with_split(df: DataFrame, key: str, seed: int = 42, train_percent: int = 80) -> DataFrame:
    """``is_train`` from a digest of the key: the same rows whatever the partitioning."""
    return df.withColumn("is_train", stable_bucket(F.col(key), seed, 100) < train_percent)


def with_fold(df: DataFrame, key: str, folds: int = 10, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", stable_bucket(F.col(key), seed, folds))
