import pytest
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from flightloom.ml import explain, models, prepare
from flightloom.operators import stats
from flightloom.plans.submission import submission

from .conftest import rows


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(300).select(
        F.col("id").alias("flightid"), (F.col("id") % 17).cast("double").alias("a"), (F.col("id") * 7 % 23).cast("double").alias("b")
    )
    return df.withColumn("target", 3 * F.col("a") - 2 * F.col("b") + 5)


@pytest.fixture(scope="module")
def ready(table):
    return prepare.with_fold(prepare.assemble(table, ["a", "b"]), "flightid", 3)


def test_linear_fit_and_persistence(ready, tmp_path):
    model = models.linear().fit(ready)
    assert list(model.coefficients) == pytest.approx([3, -2])
    assert models.score(model.transform(ready)) == pytest.approx(0, abs=1e-6)
    models.save(model, str(tmp_path / "m"))
    again = models.load(LinearRegressionModel, str(tmp_path / "m"))
    assert list(again.coefficients) == list(model.coefficients)


def test_split_and_folds_are_stable(table):
    a = prepare.with_split(prepare.with_fold(table, "flightid"), "flightid").select("flightid", "fold", "is_train")
    b = prepare.with_split(prepare.with_fold(table.repartition(11), "flightid"), "flightid").select("flightid", "fold", "is_train")
    assert rows(a) == rows(b)
    assert 0.7 < a.agg(F.avg(F.col("is_train").cast("int"))).first()[0] < 0.9


def test_cross_fit_predicts_each_row_once(ready):
    held, extra = models.cross_fit(ready, models.linear(), 3, "flightid", ready.limit(10))
    assert held.count() == 300 and held.select("flightid").distinct().count() == 300
    assert extra.count() == 30
    assert stats.mean_fold_rmse(held).first()["mean_rmse"] == pytest.approx(0, abs=1e-6)


def test_stack_and_compare(ready):
    out = models.stack(ready, ready, {"linear": models.linear(), "tree": models.forest(2)}, models.linear(), 3)
    assert models.score(out) < 1.0
    ranking = models.compare({"linear": models.linear(), "tree": models.forest(2)}, ready, ready).collect()
    assert ranking[0]["model"] == "linear"


def test_searches(ready):
    grid = models.grid_search(ready, models.boosted_shallow(2), {"maxDepth": [1, 3]}, 3)
    assert grid.count() == 2 and grid.first()["setting"] == "maxDepth=3"
    tried = models.random_search(ready, ready, models.boosted(1), {"maxDepth": (1, 3), "stepSize": (0.05, 0.3)}, 2)
    assert tried.count() == 2
    assert rows(tried) == rows(models.random_search(ready, ready, models.boosted(1), {"maxDepth": (1, 3), "stepSize": (0.05, 0.3)}, 2))


def test_importance(spark, ready):
    model = models.forest(3).fit(ready)
    got = models.importance(model, ["a", "b"], spark).collect()
    assert sum(r["importance"] for r in got) == pytest.approx(1)


def test_contributions(spark, table):
    parts = explain.linear_contributions(table, {"a": 3.0, "b": -2.0}, {"a": 8.0, "b": 11.0})
    top = explain.top_contributions(parts, ["a", "b"], 1).first()
    want = max(
        (table.agg(F.avg(F.abs(3 * (F.col("a") - 8)))).first()[0], "a"), (table.agg(F.avg(F.abs(-2 * (F.col("b") - 11)))).first()[0], "b")
    )
    assert (top["importance"], top["column"]) == pytest.approx(want[0]) or top["column"] == want[1]


def test_submission_is_zero_for_round_trips(table):
    flights = table.withColumns({"origem": F.lit("X"), "destino": F.when(F.col("flightid") % 10 == 0, "X").otherwise("Y")})
    solution, error = submission(flights, flights, ["a", "b"], models.linear(), 3)
    got = {r["ID"]: r["solution"] for r in solution.collect()}
    assert len(got) == 300 and all(got[i] == 0.0 for i in range(0, 300, 10))
    assert error.first()["mean_rmse"] == pytest.approx(0, abs=1e-6)


def test_fold_lines_equal_separate_fits(spark):
    import numpy as np

    from flightloom.ml import gram

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 50, 0.1] + [0, 1000, -99]
    x = np.column_stack([x, np.full(400, 7.0)])
    y = x[:, :3] @ [2.0, 0.1, 30.0] + rng.normal(size=400)
    fold = rng.integers(0, 4, 400)
    rows = [(int(f), *map(float, r), float(t)) for f, r, t in zip(fold, x, y)]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double, y double").repartition(5)
    lines, errors = gram.fit_folds(gram.fold_products(df, "k", ["a", "b", "c", "d", "y"]))
    mean, spread = x.mean(axis=0), np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0)
    z = np.column_stack([np.ones(400), (x - mean) / spread])
    for k in range(4):
        left = z[fold != k]
        want = np.linalg.solve(left.T @ left + gram.SHRINK * len(left) * np.diag([0, 1, 1, 1, 1]), left.T @ y[fold != k])
        guess = z[fold == k] @ want
        assert np.allclose(lines[k].intercept + x[fold == k] @ lines[k].slopes, guess, atol=1e-6)
        assert abs(errors[k] - np.sqrt(np.mean((guess - y[fold == k]) ** 2))) < 1e-6
    shown = df.select("y", gram.mean_line(lines).predict(["a", "b", "c", "d"]).alias("p")).toPandas()
    assert np.sqrt(np.mean((shown.y - shown.p) ** 2)) < 1.1


def test_missing_numbers_are_flagged_before_scaling(spark):
    rows = [(f"f{i}", "A", "B", None if i % 7 == 0 else float(i % 13), 5.0 + (100.0 if i % 7 == 0 else float(i % 13))) for i in range(200)]
    flights = spark.createDataFrame(rows, "flightid string, origem string, destino string, a double, target double")
    solution, error = submission(flights, flights, ["a"], models.linear(), 4)
    assert error.first()[0] < 0.5 and solution.count() == 200


def test_boosting_on_cells_equals_boosting_on_rows(spark, monkeypatch):
    df = spark.range(4000).select(
        F.col("id").alias("flightid"), (F.col("id") % 17).cast("double").alias("a"),
        (F.col("id") * 7 % 23).cast("double").alias("b"),
        (F.col("id") % 97 == 0).cast("double").alias("rare"),
    )
    df = df.withColumn("target", 3 * F.col("a") - 2 * F.col("b") + 40 * F.col("rare") + F.col("flightid") % 5)
    ready = prepare.assemble(df, ["a", "b", "rare"])
    of_rows = models.boosted_shallow(5).fit(ready).transform(ready).select("flightid", "prediction").orderBy("flightid").collect()
    monkeypatch.setattr(models, "CELL_ROWS", 1000)
    model = models.fit(models.boosted_shallow(5), ready)
    assert isinstance(model, models.CellModel)
    out = model.transform(ready)
    assert out.columns == [*ready.columns, "prediction"]
    of_cells = out.select("flightid", "prediction").orderBy("flightid").collect()
    assert [r.prediction for r in of_cells] == pytest.approx([r.prediction for r in of_rows])
    stacked = models.stack(prepare.with_fold(ready, "flightid", 3), ready, {"linear": models.linear(), "boosted": models.boosted_shallow(2)}, models.forest(2), 3)
    assert stacked.count() == 4000


def test_trees_that_draw_rows_are_fitted_on_rows(ready, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 10)
    for estimator in (models.forest(2), models.boosted(2), models.linear()):
        assert not isinstance(models.fit(estimator, ready), models.CellModel)
    with pytest.raises(Exception, match="(?i)label|null"):
        models.fit(models.boosted_shallow(2), ready.withColumn("target", F.when(F.col("flightid") > 3, F.col("target"))))
    for bad in ("nan", "inf", "-inf"):
        odd = ready.drop("features").withColumn("a", F.when(F.col("flightid") == 7, float(bad)).otherwise(F.col("a")))
        with pytest.raises(Exception):
            models.fit(models.boosted_shallow(2), prepare.assemble(odd, ["a", "b"]))


def test_a_fit_computes_its_rows_once(spark, table):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = prepare.assemble(table.mapInArrow(count, table.schema), ["a", "b"])
    models.fit_kept(models.forest(2), rows)
    assert seen.value == 300


def test_the_stack_boosts_in_full(spark, ready, monkeypatch):
    from flightloom.workload import models as registered

    seen = {}

    def stack(train, held_out, bases, meta, folds):
        seen.update({**bases, "meta": meta})
        return held_out.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(registered, "_halves", lambda *a: (ready, ready))
    monkeypatch.setattr(models, "stack", stack)
    registered.rf_stack(spark, "")
    assert seen["boosted"].getMaxIter() == models.boosted_shallow().getMaxIter() == 100
    assert seen["forest"].getNumTrees() == seen["meta"].getNumTrees() == 100


def test_kept_rows_are_fitted_in_few_partitions(ready, monkeypatch):
    assert models._in_few(ready.repartition(40)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "PARTITION_ROWS", 50)
    assert models._in_few(ready.repartition(40)).rdd.getNumPartitions() == 6
    assert models._in_few(ready.repartition(2)).count() == 300
