"""Periodic runs of words: maximal pairs over a bottom-up LCP-interval tree (operator 12).

A run is a stretch of consecutive words with smallest period q, at least ``least`` words and ``times`` periods long, that no
neighbouring word extends. Two suffixes i < j whose words before them differ and that share exactly L words are a maximal pair;
the stretch from i of j - i + L words then has period j - i and can't be extended. So the maximal pairs with L >= (times - 1) * (j - i)
are the runs, with nothing to extend, and one pair per run has the smallest period.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workload.registry import Registry
from . import words as W

REGISTRY = Registry()

LEAST, TIMES = 24, 3
RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))


def repeated_suffixes(ids: np.ndarray, gram: int) -> np.ndarray:
    """Starts of the suffixes whose first words, up to ``gram`` of them, occur more than once; in sorted order.

    Prefix doubling; a suffix that is alone in its class is never sorted again, so prose ends after two or three rounds.
    The result has all suffixes that share ``gram`` words with another one, and perhaps more.
    """
    n = len(ids)
    rank = np.zeros(n + 1, np.int64)
    at, group, second = np.arange(n), np.zeros(n, np.int64), ids.astype(np.int64)
    wanted = at
    h = 1
    while True:
        order = np.argsort(group * (n + 1) + second, kind="stable")
        at, group, second = at[order], group[order], second[order]
        index = np.arange(len(at))
        begins = np.ones(len(at), bool)
        begins[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        first = np.maximum.accumulate(np.where(begins, index, 0))
        base = np.ones(len(at), bool)
        base[1:] = group[1:] != group[:-1]
        rank[at] = np.maximum(group, 1) + first - np.maximum.accumulate(np.where(base, index, 0))
        alone = begins & np.append(begins[1:], True)
        at = at[~alone]
        if h <= gram:
            wanted = at
        if not len(at) or h >= n:
            break
        group, second = rank[at], rank[np.minimum(at + h, n)]
        h *= 2
    return wanted[np.argsort(rank[wanted], kind="stable")]


def shared_words(ids: np.ndarray, suffixes: np.ndarray, gram: int) -> np.ndarray:
    """For each suffix, the words that it shares with the one before it in the sorted order (0 for the first).

    In the order of the text a value is at least the last one minus 1, so that the words are read about once. That holds
    as long as ``gram`` words are left, since the suffixes are all those that share so many.
    """
    n = len(ids)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    word, previous, shared = memoryview(np.ascontiguousarray(ids)), memoryview(before), np.zeros(n, np.int64)
    have, last = 0, -2
    for i in np.sort(suffixes).tolist():
        j = previous[i]
        have = have - 1 if have > gram and i == last + 1 else 0
        if j < 0:
            have = 0
        else:
            while i + have < n and j + have < n and word[i + have] == word[j + have]:
                have += 1
        shared[i], last = have, i
    return shared[suffixes]


class Node:
    """An interval of the tree: its suffixes in the order of the text, and the same by the word before them."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int) -> None:
        self.places, self.classes = [place], {left: [place]}


def _joined(a: Node, b: Node, shared: int, reach: int, keep) -> Node:
    """Pairs between two nodes with a different word before them, at most ``reach`` apart; then both as one.

    Each suffix of the smaller node looks at the larger one's nearby suffixes, or at its classes if these are fewer.
    """
    if len(a.places) < len(b.places):
        a, b = b, a
    for left, places in b.classes.items():
        for x in places:
            low, high = bisect_left(a.places, x - reach), bisect_right(a.places, x + reach)
            if high - low > len(a.classes):
                for other, near in a.classes.items():
                    if other != left:
                        for y in near[bisect_left(near, x - reach) : bisect_right(near, x + reach)]:
                            keep(min(x, y), abs(x - y), shared)
            elif low < high:
                same = a.classes.get(left, ())
                for y in a.places[low:high]:
                    k = bisect_left(same, y)
                    if k == len(same) or same[k] != y:
                        keep(min(x, y), abs(x - y), shared)
    for left, places in b.classes.items():
        into = a.classes.get(left)
        if into is None:
            a.classes[left] = places
        else:
            _insert(into, places)
    _insert(a.places, b.places)
    return a


def _insert(into: list[int], places: list[int]) -> None:
    if len(places) == 1:
        insort(into, places[0])
    else:
        into += places
        into.sort()


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, in order of start and period."""
    gram = max(1, -(-least * (times - 1) // times))  # what two suffixes of a run share at least
    if len(ids) < least:
        return []
    suffixes = repeated_suffixes(ids, gram)
    if len(suffixes) < 2:
        return []
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, distance: int, shared: int) -> None:
        where = start, distance + shared
        if where[1] >= least and found.get(where, distance) >= distance:
            found[where] = distance

    def left(i: int) -> int:
        return int(ids[i - 1]) if i else -1

    places = suffixes.tolist()
    open_nodes: list[tuple[int, Node]] = []
    node = Node(places[0], left(places[0]))
    for place, shared in zip(places[1:], shared_words(ids, suffixes, gram)[1:].tolist(), strict=True):
        while open_nodes and open_nodes[-1][0] > shared:
            depth, up = open_nodes.pop()
            node = _joined(up, node, depth, depth // (times - 1), keep)
        if shared >= gram:
            if open_nodes and open_nodes[-1][0] == shared:
                node = _joined(open_nodes.pop()[1], node, shared, shared // (times - 1), keep)
            open_nodes.append((shared, node))
        node = Node(place, left(place))
    while open_nodes:
        depth, up = open_nodes.pop()
        node = _joined(up, node, depth, depth // (times - 1), keep)
    return sorted(((start, length, period) for (start, length), period in found.items()), key=lambda r: (r[0], r[2]))


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for the same word only."""
    seen: dict[bytes, int] = {}
    return np.fromiter(map(seen.setdefault, words, range(len(words))), np.int32, len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _searched(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.portions(batches, "content"):
            found, texts = [], []
            for text in batch.column("content").cast(pa.large_binary()).to_pylist():
                words = (text or b"").split()
                runs = find_runs(numbered(words), least, times)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(b" ".join(collapse(words, runs)).decode())
            columns = [batch.column("doc"), pa.array(found, RUNS), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Key, ``runs`` (start, length, period in words, by start and period) and the ``collapsed`` text of each document.

    Words end at space, tab, line feed, vertical tab, form feed and carriage return. A word is left out of ``collapsed`` if any run has it after
    the run's first period; the others are joined by one space. One row per row, in the row's own task, with nothing shuffled:
    repeated keys and texts and NULL keys keep their rows; a NULL, empty or blank text has no runs and an empty ``collapsed``.
    Memory grows with the longest text. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    schema = f"doc {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return rows.mapInArrow(_searched(least, times), schema).withColumnRenamed("doc", key)


def with_periods(text: Column, number: Column) -> Column:
    """The contract's texts: for a tenth of the numbers, the words from one place on repeat with a period that the number gives.

    A NULL number changes nothing.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    h = F.crc32(number.cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rest = (n - a).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), rest)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


@REGISTRY.add("op12_runs")
def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = periodic_runs(docs.select("doc_id", with_periods(F.coalesce("text", F.lit("")), F.col("doc_id")).alias("text")))

    def better(a: Column, b: Column) -> Column:
        one, other = a["length"] * b["period"], b["length"] * a["period"]
        earlier = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return F.when(one > other, -1).when(one < other, 1).when(earlier, -1).otherwise(1)

    best = F.get(F.array_sort("runs", better), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.expr("best.length * 1000 div best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
