"""Cross-validated model and the table of predictions it yields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import override
from ..ml import gram, models, prepare
from ..operators.clean import with_missing_flags
from ..operators.encode import scaling, standardise
from ..operators.stats import mean_fold_rmse


def submission(
    train: DataFrame, test: DataFrame, features: Sequence[str], estimator: Estimator, folds: int = 10, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Returns ``(ID, solution)`` and the mean fold error.

    Missing numbers get -99 and a 0/1 column that says so, before scaling, which is fitted on the training rows. Flights that end
    where they start get 0.
    """
    usable = with_missing_flags(train.where(F.col("origem") != F.col("destino")), features)
    inputs = [*features, *(f"{c}_missing" for c in features)]
    fitted = scaling(usable, inputs)
    ready = prepare.with_fold(prepare.assemble(standardise(usable, fitted), inputs), "flightid", folds, seed)
    ready = ready.select("flightid", "fold", "target", "features")
    scored = prepare.assemble(standardise(with_missing_flags(test, features), fitted), inputs)
    held, predictions = models.cross_fit(ready, estimator, folds, "flightid", scored.select("flightid", "features"))
    return _with_round_trips(test, models.ensemble(predictions, "flightid")), mean_fold_rmse(held)


def _with_round_trips(test: DataFrame, solution: DataFrame) -> DataFrame:
    same = test.select("flightid", (F.col("origem") == F.col("destino")).alias("_same"))
    return solution.join(same, "flightid").select(
        F.col("flightid").alias("ID"), override(F.col("_same"), 0.0, F.col("solution")).alias("solution")
    )


def linear_submission(
    train: DataFrame, test: DataFrame, features: Sequence[str], folds: int = 10, seed: int = 42, shrink: float = gram.SHRINK
) -> tuple[DataFrame, DataFrame]:
    """As :func:`submission` with lines as fold models, from one scan of the training rows.

    ``same``, a boolean column of both tables, marks flights that end where they start. Returns ``(ID, solution)`` and (fold, rmse).
    """
    inputs = [*features, *(f"{c}_missing" for c in features)]
    usable = with_missing_flags(train.where(~F.col("same")), features)
    by_fold = gram.fold_products(prepare.with_fold(usable, "flightid", folds, seed), "fold", [*inputs, "target"])
    if len(by_fold) < 2:
        raise ValueError("fewer than two folds have rows to learn from")
    lines, errors = gram.fit_folds(by_fold, shrink)
    scored = with_missing_flags(test, features)
    solution = F.when(F.col("same"), 0.0).otherwise(gram.mean_line(lines).predict(inputs))
    out = scored.select(F.col("flightid").alias("ID"), solution.alias("solution"))
    return out, train.sparkSession.createDataFrame(sorted(errors.items()), "fold int, rmse double")
