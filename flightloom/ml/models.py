"""Regression models on Spark ML: fitting, comparing, stacking and searching."""

from __future__ import annotations

import math
import random
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel
from pyspark.util import inheritable_thread_target

from ..operators.stats import rmse
from ..session import cut_lineage
from .prepare import assemble

TARGET = "target"


def linear(**params) -> LinearRegression:
    return LinearRegression(labelCol=TARGET, solver="normal", **params)


def boosted_shallow(rounds: int = 100, **params) -> GBTRegressor:
    """Depth 3, step 0.15."""
    return GBTRegressor(labelCol=TARGET, maxDepth=3, stepSize=0.15, maxIter=rounds, seed=42, **params)


def boosted(rounds: int = 100, **params) -> GBTRegressor:
    """About 31 leaves, step 0.05, nine tenths of the features and eight tenths of the rows per tree."""
    return GBTRegressor(
        labelCol=TARGET, maxDepth=5, stepSize=0.05, maxIter=rounds, subsamplingRate=0.8,
        featureSubsetStrategy="0.9", seed=42, **params,
    )


def boosted_until_flat(rounds: int = 1000, tolerance: float = 0.01, flag: str = "is_validation") -> GBTRegressor:
    """Stops adding trees once the rows marked by ``flag`` no longer gain."""
    return boosted(rounds, validationIndicatorCol=flag, validationTol=tolerance)


def forest(trees: int = 100, **params) -> RandomForestRegressor:
    """Nodes of rows are remembered from one depth to the next, which changes no tree."""
    return RandomForestRegressor(labelCol=TARGET, numTrees=trees, seed=1, cacheNodeIds=True, **params)


#: Fits that run at the same time; their jobs share the executors and the rows kept for them.
AT_ONCE = 4


@contextmanager
def _kept(*tables: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """The tables, kept on the executors for as many fits as need them, and released afterwards."""
    kept = tuple(t.persist(StorageLevel.MEMORY_AND_DISK) for t in tables)
    try:
        yield kept
    finally:
        for t in kept:
            t.unpersist()


#: Rows of a partition while boosted trees are fitted, at least: each round runs several jobs with a task for each partition.
PARTITION_ROWS = 25_000


def _in_few(kept: DataFrame) -> DataFrame:
    """Kept rows in no more partitions than their number asks for; a table from a shuffle may have hundreds with next to no rows."""
    return kept.coalesce(max(1, -(-kept.count() // PARTITION_ROWS)))


def _together(spark, tasks: Sequence[Callable]) -> list:
    """Results of independent fits, a few at a time; small late stages of one fit leave room that the others use."""
    with ThreadPool(min(AT_ONCE, len(tasks)) or 1) as pool:
        return pool.map(lambda task: inheritable_thread_target(spark)(task)(), tasks)


#: From so many rows on, boosting is fitted on cells.
CELL_ROWS = 100_000
#: Rows whose values bound the bins of a cell, about; Spark ML's own trees look at 10,000.
BOUND_ROWS = 20_000


@dataclass
class CellModel:
    """A model of bin numbers, for rows with their features as they are."""

    model: Model
    bounds: list[list[float]]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(_assembled(_binned(df, self.bounds), self.bounds)).drop("_bins")


def _bounds(rows: DataFrame, count: int, bins: int, features: str) -> list[list[float]]:
    """Per feature, what lies between its values if these are at most ``bins``, else quantiles, in a bounded sample."""
    values = rows.select(vector_to_array(features).alias("x")).sample(min(1.0, BOUND_ROWS / count), seed=1).toPandas()["x"]
    out = []
    for column in np.array(values.tolist()).T:
        column = column[np.isfinite(column)]
        kinds = np.unique(column)
        cuts = (kinds[1:] + kinds[:-1]) / 2 if len(kinds) <= bins else np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))
        out.append([-math.inf, *map(float, cuts if len(cuts) else [0.0]), math.inf])
    return out


def _binned(df: DataFrame, bounds: list[list[float]], features: str = "features", strict: bool = False) -> DataFrame:
    """Bin numbers in columns _b0, _b1 and so on; NaN has the last one, since trees send it to the right.

    With ``strict``, NaN and infinite values are an error, as they are where Spark ML fits trees.
    """
    each = vector_to_array(features)
    raw, names = [f"_x{i}" for i in range(len(bounds))], [f"_b{i}" for i in range(len(bounds))]
    if strict:
        bounds = [[-sys.float_info.max, *b[1:-1], sys.float_info.max] for b in bounds]
    cut = Bucketizer(splitsArray=bounds, inputCols=raw, outputCols=names, handleInvalid="error" if strict else "keep")
    out = cut.transform(df.withColumns({x: each[i] for i, x in enumerate(raw)})).drop(*raw)
    return out.withColumns({n: F.col(n) + F.lit(0.0) for n in names})  # plain numbers: as categories, bins would lose their order


def _assembled(df: DataFrame, bounds: list[list[float]]) -> DataFrame:
    names = [f"_b{i}" for i in range(len(bounds))]
    return VectorAssembler(inputCols=names, outputCol="_bins").transform(df).drop(*names)


def fit(estimator: Estimator, rows: DataFrame) -> Model | CellModel:
    """``estimator.fit``, for boosted trees on many rows by cells: rows that fall into the same bins are one row with their mean and number.

    Trees tell rows apart by their bins only, and with squared losses on all rows a split or a leaf depends on the sums and numbers of
    its bins alone, so cells give the trees of the rows; how many cells there are does not grow with the rows. Trees that
    draw rows (forests, sampled boosting) need each row and are fitted on rows.
    """
    whole = isinstance(estimator, GBTRegressor) and estimator.getLossType() == "squared" and estimator.getSubsamplingRate() == 1.0
    if not whole or estimator.isDefined(estimator.weightCol) or estimator.isDefined(estimator.validationIndicatorCol):
        return estimator.fit(rows)
    count = rows.count()
    if count < CELL_ROWS:
        return estimator.fit(rows)
    label = estimator.getLabelCol()
    bounds = _bounds(rows, count, estimator.getMaxBins(), estimator.getFeaturesCol())
    keys = [f"_b{i}" for i in range(len(bounds))]
    known = F.count(label) == F.count(F.lit(1))  # a missing label stays missing, which the fit refuses
    cells = _binned(rows, bounds, estimator.getFeaturesCol(), strict=True).groupBy(*keys).agg(
        F.when(known, F.avg(label)).alias(label), F.count(F.lit(1)).cast("double").alias("_rows")
    )
    on_cells = estimator.copy({estimator.featuresCol: "_bins", estimator.weightCol: "_rows"})
    with _kept(_assembled(cells, bounds)) as (kept,):
        return CellModel(on_cells.fit(_in_few(kept)), bounds)


def fit_kept(estimator: Estimator, rows: DataFrame) -> Model | CellModel:
    """``fit`` on rows that are computed once, not once for each pass of the fit."""
    with _kept(rows) as (kept,):
        return fit(estimator, kept)


def score(predictions: DataFrame) -> float:
    return predictions.agg(rmse(F.col(TARGET), F.col("prediction")).alias("rmse")).first()["rmse"]


def compare(models: Mapping[str, Estimator], train: DataFrame, held_out: DataFrame) -> DataFrame:
    """(model, rmse) on the held-out rows, best first."""
    with _kept(train, held_out) as (train, held_out):
        tasks = [lambda n=n, e=e: (n, score(fit(e, train).transform(held_out))) for n, e in models.items()]
        rows = _together(train.sparkSession, tasks)
    return train.sparkSession.createDataFrame(rows, "model string, rmse double").orderBy("rmse", "model")


def cross_fit(train: DataFrame, estimator: Estimator, folds: int, key: str, other: DataFrame | None = None):
    """Fit once per fold on the other folds.

    Returns the held-out predictions (key, fold, target, prediction) and, if another table
    is given, each fold model's predictions for it (key, fold, prediction); both as written tables.
    """
    with _kept(train) as (rows,):
        fitted = _together(train.sparkSession, [lambda k=k: estimator.fit(rows.where(F.col("fold") != k)) for k in range(folds)])
        held = [m.transform(rows.where(F.col("fold") == k)).select(key, "fold", TARGET, "prediction") for k, m in enumerate(fitted)]
        joined = cut_lineage(reduce(DataFrame.unionByName, held))
    if other is None:
        return joined, None
    with _kept(other) as (rows,):
        extra = [m.transform(rows).select(key, F.lit(k).alias("fold"), "prediction") for k, m in enumerate(fitted)]
        return joined, cut_lineage(reduce(DataFrame.unionByName, extra))


def ensemble(predictions: DataFrame, key: str) -> DataFrame:
    """Mean over the fold models."""
    return predictions.groupBy(key).agg(F.avg("prediction").alias("solution"))


def _named(estimators: Mapping[str, Estimator]) -> dict[str, Estimator]:
    return {n: e.copy({e.predictionCol: f"p_{n}"}) for n, e in estimators.items()}


def _apply(models: Sequence[Model], df: DataFrame) -> DataFrame:
    return reduce(lambda d, m: m.transform(d), models, df)


def stack(
    train: DataFrame, held_out: DataFrame, bases: Mapping[str, Estimator], meta: Estimator, folds: int
) -> DataFrame:
    """Predictions of a meta model fitted on out-of-fold predictions of the base models.

    The base models add one column each to the same rows, so no join by id is needed.
    """
    named = _named(bases)
    inputs = [f"p_{n}" for n in named]
    with _kept(train) as (rows,):
        few = _in_few(rows)
        fits = [lambda e=e, k=k: fit(e, few if k is None else few.where(F.col("fold") != k)) for k in [*range(folds), None] for e in named.values()]
        fitted = _together(train.sparkSession, fits)
        models = [fitted[i : i + len(named)] for i in range(0, len(fitted), len(named))]
        parts = [_apply(models[k], rows.where(F.col("fold") == k)) for k in range(folds)]
        level_one = cut_lineage(reduce(DataFrame.unionByName, parts).drop("features"))
    final = fit_kept(meta, assemble(level_one, inputs))
    return final.transform(assemble(_apply(models[-1], held_out).drop("features"), inputs))


def grid_search(
    train: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], folds: int = 5, parallelism: int = 4
) -> DataFrame:
    """(setting, rmse) of every grid point by cross-validation on the ``fold`` column, best first."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    points = builder.build()
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=points, numFolds=folds, foldCol="fold", parallelism=parallelism,
        evaluator=RegressionEvaluator(labelCol=TARGET, metricName="rmse"),
    )
    with _kept(train) as (kept,):
        means = search.fit(kept).avgMetrics
    rows = [
        (", ".join(f"{p.name}={v}" for p, v in sorted(point.items(), key=lambda i: i[0].name)), float(m))
        for point, m in zip(points, means)
    ]
    return train.sparkSession.createDataFrame(rows, "setting string, rmse double").orderBy("rmse", "setting")


def random_search(
    train: DataFrame, held_out: DataFrame, estimator: Estimator, space: Mapping[str, tuple], tries: int, seed: int = 42
) -> DataFrame:
    """(setting, rmse) of settings drawn uniformly from (low, high) ranges, best first."""
    draw = random.Random(seed)
    points = [
        {n: draw.randint(low, high) if isinstance(low, int) and isinstance(high, int) else draw.uniform(low, high) for n, (low, high) in space.items()}
        for _ in range(tries)
    ]

    def tried(point: dict, train: DataFrame, held_out: DataFrame) -> tuple[str, float]:
        params = {estimator.getParam(n): str(v) if n == "featureSubsetStrategy" else v for n, v in point.items()}
        setting = ", ".join(f"{n}={round(v, 4)}" for n, v in sorted(point.items()))
        return setting, score(estimator.fit(train, params).transform(held_out))

    with _kept(train, held_out) as (kept, rest):
        rows = _together(train.sparkSession, [lambda p=p: tried(p, kept, rest) for p in points])
    return train.sparkSession.createDataFrame(rows, "setting string, rmse double").orderBy("rmse", "setting")


def importance(model: Model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), most important first."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def save(model: Model, path: str) -> None:
    model.write().save(path)


def load(kind: type, path: str) -> Model:
    return kind.load(path)
