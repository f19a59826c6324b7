"""Linear models of all folds from one pass over the rows: sums of products per fold.

With the sums of x x' and x y of each fold, the fit without a fold is the total less that fold, its error on the held-out rows is a
quadratic form of the fold's own sums, and means and spreads are sums as well. So scaling, k fits and k errors cost one scan,
whatever the number of folds; what reaches the driver is one square matrix per fold, whose size is the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of the squared coefficients per row, which keeps columns that say the same from cancelling each other.
SHRINK = 1e-3
_SUMS = pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("sums", pa.list_(pa.float64()))])
_SUMS_SQL = "fold int, row int, sums array<double>"


def _emit(found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for fold, matrix in found.items():
        columns = [pa.array([fold] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()), pa.array(list(matrix), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=_SUMS)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        folds = batch.column(0).to_numpy()
        rows = np.column_stack([np.ones(len(folds)), *(c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])])
        for fold in np.unique(folds):
            part = rows[folds == fold]
            found[int(fold)] = found.get(int(fold), 0.0) + part.T @ part
    return _emit(found)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for fold, row, sums in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found[fold, row] = found.get((fold, row), 0.0) + np.array(sums)
    if found:
        columns = [pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, schema=_SUMS)


def fold_products(df: DataFrame, fold: str, columns: Sequence[str]) -> dict[int, np.ndarray]:
    """Per fold, the sums of products of 1 and ``columns`` with each other. Columns must hold no NULL.

    A task keeps one matrix per fold, however many rows it has; the matrices of all tasks are added row by row of the matrix.
    """
    cells = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    parts = df.select(F.col(fold).cast("int").alias("fold"), *cells).mapInArrow(_products, _SUMS_SQL)
    size = len(columns) + 1
    found: dict[int, np.ndarray] = {}
    for r in parts.repartition("fold", "row").mapInArrow(_added, _SUMS_SQL).collect():  # one row per fold and column
        found.setdefault(r["fold"], np.zeros((size, size)))[r["row"]] = r["sums"]
    return found


@dataclass
class Line:
    """Intercept and one coefficient per column, for columns as they are (not scaled)."""

    intercept: float
    slopes: np.ndarray

    def predict(self, columns: Sequence[str]) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(columns, self.slopes, strict=True):
            out = out + F.col(f"`{c}`").cast("double") * F.lit(float(w))
        return out


def fit_line(products: np.ndarray, mean: np.ndarray, spread: np.ndarray, shrink: float = SHRINK) -> Line:
    """The line of least squares for the last column, on columns scaled by ``mean`` and ``spread``; the intercept is not shrunk."""
    n, p = products[0, 0], len(mean)
    scale = np.eye(p + 1)
    scale[0, 1:] = -mean / spread
    scale[1:, 1:] = np.diag(1 / spread)
    inner = scale.T @ products[:-1, :-1] @ scale + np.diag([0.0, *[shrink * n] * p])
    raw = scale @ np.linalg.solve(inner, scale.T @ products[:-1, -1])
    return Line(float(raw[0]), raw[1:])


def fit_folds(by_fold: dict[int, np.ndarray], shrink: float = SHRINK) -> tuple[dict[int, Line], dict[int, float]]:
    """For each fold, the line fitted on all other folds, and its root mean square error on the fold itself."""
    total = sum(by_fold.values())
    mean = total[0, 1:-1] / total[0, 0]
    variance = np.diag(total)[1:-1] / total[0, 0] - mean**2
    spread = np.where(variance > 1e-9 * np.maximum(mean**2, 1e-3), np.sqrt(np.maximum(variance, 0)), 1.0)
    lines, errors = {}, {}
    for fold, own in sorted(by_fold.items()):
        rest = total - own
        if rest[0, 0] < 1:
            continue
        line = lines[fold] = fit_line(rest, mean, spread, shrink)
        way = np.array([-line.intercept, *-line.slopes, 1.0])
        errors[fold] = float(np.sqrt(max(way @ own @ way, 0.0) / own[0, 0]))
    return lines, errors


def mean_line(lines: dict[int, Line]) -> Line:
    """The mean of the fold models' predictions, which for lines is a line."""
    return Line(float(np.mean([m.intercept for m in lines.values()])), np.mean([m.slopes for m in lines.values()], axis=0))
