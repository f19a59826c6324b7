"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_written


def _pointed(edges: DataFrame) -> DataFrame:
    """Links from the larger to the smaller end, once."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of ``links`` (a, b) reaches, itself included.

    Each round points all larger neighbours of a node at its smallest neighbour, then all smaller
    ones; the links end as stars around the roots. A node with very many links is summed up by
    partial aggregates and joined, never collected. Every round is a written table; the
    number of rounds grows with the logarithm of the longest path.
    """
    edges = cut_lineage(_pointed(links))
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _pointed(large)
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, F.col("a") == F.col("n"))
        after = cut_lineage(_pointed(small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m"))))
        now = _state(after)
        drop_written(edges.sparkSession, edges)
        edges, before, state = after, state, now
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
