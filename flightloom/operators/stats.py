"""Table statistics."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import bin_number, clip_rescale, side_of_stack
from .positions import exact_percentiles, long_form, position_in_group, value_counts

QUARTILES = (0.25, 0.5, 0.75)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles of each column."""
    cells = long_form(df, columns)
    basic = cells.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return basic.join(_wide(exact_percentiles(value_counts(cells), QUARTILES), QUARTILES, ["q25", "q50", "q75"]), "column", "left")


def _wide(points: DataFrame, probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
    pick = [
        F.max(F.when(F.col("probability") == F.lit(p), F.col("percentile"))).alias(n)
        for p, n in zip(probabilities, names)
    ]
    return points.groupBy("column").agg(*pick)


def profile(df: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, rows, missing, distinct, most frequent value, and for numbers the description."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col(f"`{c}`").cast("string").alias("value"))
        for c in [*numeric, *text]
    ]
    counts = df.select(F.explode(F.array(*cells)).alias("_c")).groupBy("_c.column", "_c.type", "_c.value").agg(
        F.count(F.lit(1)).alias("rows")
    )
    known = F.col("value").isNotNull()
    shape = counts.groupBy("column", "type").agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(known, 0).otherwise(F.col("rows"))).alias("missing"),
        F.count("value").alias("distinct"),
        F.min_by("value", F.when(known, F.struct(-F.col("rows"), F.col("value")))).alias("top"),
        F.max(F.when(known, F.col("rows"))).alias("top_rows"),
    )
    return shape.join(describe(df, numeric).drop("count"), "column", "left")


def correlations(df: DataFrame, columns: Sequence[str], pairs_per_pass: int = 400) -> DataFrame:
    """(a, b, corr) for each unordered pair, leaving out rows where either is NULL."""
    pairs = list(combinations(columns, 2))
    out = None
    for i in range(0, len(pairs), pairs_per_pass):
        part = pairs[i : i + pairs_per_pass]
        wide = df.agg(*[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{j}") for j, (a, b) in enumerate(part)])
        rows = [
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{j}").alias("corr"))
            for j, (a, b) in enumerate(part)
        ]
        one = wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
        out = one if out is None else out.unionByName(one)
    return out


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs, with 1 on the diagonal of columns that vary."""
    half = correlations(df, columns)
    other = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    diagonal = df.agg(*[F.corr(F.col(f"`{c}`"), F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(columns)])
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(f"c{i}").alias("corr")) for i, c in enumerate(columns)]
    return half.unionByName(other).unionByName(diagonal.select(F.explode(F.array(*cells)).alias("_r")).select("_r.*"))


def strong_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.8) -> DataFrame:
    return correlations(df, columns).where(F.col("corr") > F.lit(threshold))


def prune_correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """Columns left after dropping, from the closest pair each time, the one closer to all others.

    The correlations come from Spark once; only the columns-by-columns table is handled here,
    since dropping a column does not change the others' correlations. Of two equally close
    candidates the later column goes.
    """
    found = {(r["a"], r["b"]): abs(r["corr"]) for r in correlations(df, columns).collect() if r["corr"] is not None}
    found.update({(b, a): v for (a, b), v in list(found.items())})
    kept = list(columns)

    def closeness(c: str) -> float:
        return sum(found.get((c, other), 0.0) for other in kept if other != c)

    while True:
        pairs = [(found.get(p, 0.0), p) for p in combinations(kept, 2)]
        top = max((v for v, _ in pairs), default=0.0)
        if not pairs or top < threshold:
            return kept
        a, b = next(p for v, p in pairs if v == top)
        kept.remove(a if closeness(a) > closeness(b) else b)


def sparsity(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of cells that are zero. Missing cells count as non-zero, as in a sparse matrix of NaNs."""
    zero = [F.sum(F.when(F.col(f"`{c}`") == 0, 1).otherwise(0)) for c in columns]
    total = zero[0]
    for z in zero[1:]:
        total = total + z
    cells = F.count(F.lit(1)) * F.lit(len(columns))
    return df.agg(total.alias("zeros"), cells.alias("cells"), (total / cells).alias("sparsity"))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg((actual - predicted) * (actual - predicted)))


def mean_fold_rmse(predictions: DataFrame) -> DataFrame:
    """Mean over folds of each fold's error; columns fold, target, prediction."""
    folds = predictions.groupBy("fold").agg(rmse(F.col("target"), F.col("prediction")).alias("rmse"))
    return folds.agg(F.avg("rmse").alias("mean_rmse"), F.count(F.lit(1)).alias("folds"))


def percentile_row(df: DataFrame, column: str, probabilities: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row with the exact percentiles of a column."""
    points = exact_percentiles(value_counts(long_form(df, [column])), probabilities)
    return _wide(points, probabilities, names).drop("column")


def rescaled(df: DataFrame, column: str, name: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip a column to two percentiles and stretch it to [0, 1]."""
    # One row with two numbers.
    ends = percentile_row(df, column, (low, high), ("low", "high")).first()
    if ends is None:
        return df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn(name, clip_rescale(F.col(column), F.lit(ends["low"]), F.lit(ends["high"])))


def swarm_layout(
    df: DataFrame, column: str, key: str, width: float = 0.05, step: float = 0.12, rows_per_task: int | None = None
) -> DataFrame:
    """Bin number and height of each mark: marks of a bin stack up, sides alternating."""
    binned = df.withColumn("bin", bin_number(F.col(column), width))
    placed = position_in_group(binned, ["bin"], [column, key], "_rank", rows_per_task)
    return placed.withColumn("y", side_of_stack(F.col("_rank"), step)).drop("_rank")


def mean_abs_ranking(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """(column, importance) by mean absolute value, largest first."""
    ranked = (
        long_form(df, columns).groupBy("column").agg(F.avg(F.abs("value")).alias("importance"))
        .orderBy(F.desc("importance"), "column")
    )
    return ranked.limit(top) if top else ranked


def seeded_sample(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A fixed-size sample without replacement: the rows with the smallest seeded digests."""
    digest = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(digest, key).limit(size)
