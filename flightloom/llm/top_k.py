"""Exact top-k search by inner product: columns in blocks, dimensions step by step, bounds on the rest (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry

REGISTRY = Registry()

LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``id`` and ``whole`` = floor(scale * x) of each component, for vectors without NULL or non-finite components.

    Rows that repeat an id count once, with the smallest vector.
    """
    x = F.col("v")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & x.isNotNull() & ~bad)
    whole = F.transform(x, lambda c: F.floor(c * F.lit(scale)).cast("long"))
    return rows.select("id", whole.alias("whole")).groupBy("id").agg(F.min("whole").alias("whole"))


def _vertical(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of vectors as one row: sorted ids, and all values dimension by dimension, as numbers no wider than they need. Short vectors end in zeros."""
    rows = rows.sort_values("id")
    width = int(rows["whole"].map(len).max())
    columns = np.zeros((width, len(rows)), np.int64)
    for i, v in enumerate(rows["whole"]):
        columns[: len(v), i] = v
    low, high = int(columns.min(initial=0)), int(columns.max(initial=0))
    kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    ids = rows["id"].to_numpy(np.int64)
    return pd.DataFrame(
        {"block": [int(rows["block"].iloc[0])], "ids": [ids.tobytes()], "width": [width], "kind": [kind], "columns": [columns.astype(kind).tobytes()]}
    )


def _masses(columns: np.ndarray, edges: list[int]) -> np.ndarray:
    """Length of what is left of each vector from every edge on; one row per edge and one of zeros."""
    parts = [np.square(columns[a:b]).sum(axis=0) for a, b in zip(edges, [*edges[1:], len(columns)], strict=True)]
    left = np.cumsum(parts[::-1], axis=0)[::-1] if parts else np.zeros((0, columns.shape[1]))
    return np.sqrt(np.vstack([left, np.zeros((1, columns.shape[1]))]))


def _best(partial: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest, first come first in ties."""
    if len(partial) > 4 * k:
        least = np.partition(partial, len(partial) - k)[len(partial) - k]
        near = np.flatnonzero(partial >= least)
    else:
        near = np.arange(len(partial))
    return near[np.argsort(-partial[near], kind="stable")][:k]


def search_block(ids: np.ndarray, columns: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, step: int):
    """The k best of one block for each query: yields query id, vector ids and scores.

    All candidates get the products of the first ``step`` dimensions. The k best so far are finished,
    which gives a score to beat; then dimensions follow step by step, and a candidate whose
    partial score plus the product of the lengths of both rests stays below that score is left out.
    """
    width = min(len(columns), len(queries))
    columns, queries = columns[:width], queries[:width]
    most = float(np.abs(columns.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * width
    if most >= 2.0**53:  # beyond exact doubles: whole numbers of any size, and no bounds
        for i, query in enumerate(query_ids):
            other = np.flatnonzero(ids != query)
            scores = np.array([sum(int(a) * int(b) for a, b in zip(columns[:, j], queries[:, i], strict=True)) for j in other], object)
            top = sorted(range(len(other)), key=lambda j: (-scores[j], j))[:k]
            yield query, ids[other[top]], [min(max(int(scores[j]), LONG.min), LONG.max) for j in top]
        return
    columns, queries = columns.astype(np.float64), queries.astype(np.float64)
    edges = list(range(0, width, step)) or [0]
    rest, own_rest = _masses(columns, edges), _masses(queries, edges)
    first = queries[:step].T @ columns[:step]
    at = np.searchsorted(ids, query_ids)
    for i, query in enumerate(query_ids):
        alive = np.arange(len(ids))
        if at[i] < len(ids) and ids[at[i]] == query:
            alive = np.delete(alive, at[i])
        partial = first[i, alive]
        beat = -np.inf
        if len(alive) > k and len(edges) > 1:
            seed = alive[np.argpartition(partial, len(alive) - k)[len(alive) - k :]]
            beat = (queries[:, i] @ columns[:, seed]).min()
        for n, a in enumerate(edges[1:], 1):
            bound = partial + own_rest[n, i] * rest[n, alive]
            stay = bound * (1 + 1e-12 * np.sign(bound)) + 1e-6 >= beat
            alive, partial = alive[stay], partial[stay]
            partial = partial + queries[a : a + step, i] @ columns[a : a + step, alive]
        top = _best(partial, k)
        yield query, ids[alive[top]], partial[top].astype(np.int64)


def _search(k: int, step: int):
    def run(cells: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in cells:
            found = []
            for c in frame.itertuples(index=False):
                ids, query_ids = np.frombuffer(c.ids, np.int64), np.frombuffer(c.query_ids, np.int64)
                columns = np.frombuffer(c.columns, c.kind).astype(np.int64).reshape(c.width, len(ids))
                queries = np.frombuffer(c.queries, c.query_kind).astype(np.int64).reshape(c.query_width, len(query_ids))
                for query, vectors, scores in search_block(ids, columns, query_ids, queries, k, step):
                    found.append(pd.DataFrame({"query_id": int(query), "vec_id": vectors, "score": scores}))
            if found:
                yield pd.concat(found, ignore_index=True).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").applyInPandas(_vertical, "block int, ids binary, width int, kind string, columns binary")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    block: int = 4096,
    query_block: int = 1024,
    step: int = 16,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the k best other vectors of each query, exactly.

    ``is_query`` is a condition on ``id``. Candidates are dealt by a hash of their id into blocks of about ``block``,
    stored dimension by dimension; every block meets the queries in blocks of about ``query_block``, and returns k rows a
    query. A common vector in many copies is spread over all blocks. Ties go to the smaller id; vectors that are NULL or
    hold NULL, NaN or infinite components take no part; a query with fewer than k others gets all of them; missing
    components of shorter vectors count as 0; scores beyond a long stop at its ends. Other columns are not read.
    """
    rows = cut_lineage(usable(vectors, key, vector, scale))
    asked = rows.where(is_query)
    candidates = cut_lineage(_blocks(rows, block))
    queries = _blocks(asked, query_block).select(
        F.explode(F.sequence(F.lit(0), F.lit(max(0, _last_block(candidates))))).alias("block"),
        F.col("ids").alias("query_ids"),
        F.col("width").alias("query_width"),
        F.col("kind").alias("query_kind"),
        F.col("columns").alias("queries"),
    )
    # Merged, never broadcast: the planner's sizes leave out that the queries come once for each block.
    found = candidates.join(queries.hint("merge"), "block").mapInPandas(_search(k, step), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _last_block(blocks: DataFrame) -> int:
    return blocks.agg(F.max("block")).first()[0] or 0


@REGISTRY.add(
    "op1_top_k",
    """
    WITH v AS (
        SELECT vec_id, min(list_transform(embedding, lambda x: floor(256 * x::DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        GROUP BY vec_id
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
)
def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)
