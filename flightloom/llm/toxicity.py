"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from document labels (operator 4).

A document is toxic if one of its sentences is: P = 1 - product of (1 - p of each sentence), and p is a logistic
function of the sentence's words. Only the document's label is known in training; the sentences that carry it
come out of the fit, and the same sentence scores then locate the offending passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_written
from ..workload.registry import Registry
from . import words as W

REGISTRY = Registry()

#: Bounds of the labelled sample that one task fits the model on, in documents and in words.
MAX_DOCUMENTS, MAX_WORDS = 20_000, 6_000_000
#: Documents of more than this part of the words take only what shorter ones leave of the bound.
SHARE = 100
#: Hashes of documents that wait until they are summed up.
STEP = 1 << 21
#: A word or beginning must be in so many sampled documents to become a feature.
MIN_DOCUMENTS = 4
#: Longer words also count by their first bytes, of these numbers.
BEGINNINGS = (5, 6, 7, 8)
#: Features of a word: itself, and its beginnings.
EACH = 1 + len(BEGINNINGS)

_LETTER = W.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x27, 0x27), (0x80, 0xFF))
_NOT_LETTER = ~_LETTER
_STOP = W.byte_set((0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F), (0x0A, 0x0A))


def sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (one row per word), the first word of each sentence, sentences before each text, starts and ends of words.

    Words are runs of letters, digits and apostrophes, lower-cased in A-Z; a sentence ends at . ! ? or a line's end. A
    word's features are itself and its beginnings; a short word repeats itself in their places, with hashes of no weight.
    """
    starts, ends, before = W.spans(buf, offsets, _NOT_LETTER)
    stops = np.cumsum(_STOP[buf], dtype=np.int64)[starts] if len(starts) else starts
    new = np.ones(len(starts), bool)
    new[1:] = stops[1:] != stops[:-1]
    new[before[:-1][before[:-1] < len(starts)]] = True
    first = np.flatnonzero(new)
    cuts = [ends, *(np.minimum(starts + n, ends) for n in BEGINNINGS)]
    hashes = np.stack(W.range_hashes(buf, starts, ends, cuts, W.letters(True)), axis=1)
    for n, size in enumerate(BEGINNINGS, 1):
        hashes[:, n] = np.where(ends - starts > size, hashes[:, n] ^ W.U(n), W.U(0))
    return hashes, first, np.searchsorted(first, before), starts, ends


@dataclass
class Model:
    keys: np.ndarray  # sorted word hashes
    weights: np.ndarray  # one more than keys: 0 for all other words
    bias: float

    def sentence_scores(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Logits of sentences; a feature counts as often as it occurs."""
        if not len(first):
            return np.zeros(0)
        if not len(self.keys):
            return np.full(len(first), self.bias)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        found = np.where(self.keys[at] == hashes, self.weights[at], 0.0)
        return self.bias + np.add.reduceat(found.sum(axis=1), first)


def noisy_or(logits: np.ndarray, before: np.ndarray) -> np.ndarray:
    """1 - product of (1 - p) per document; 0 without sentences."""
    sums = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, logits))])
    return np.clip(-np.expm1(-(sums[before[1:]] - sums[before[:-1]])), 0.0, 1.0)


def _counted(parts: Iterator[tuple]) -> np.ndarray:
    """Sorted hashes that at least ``MIN_DOCUMENTS`` documents have, summed up a few parts at a time."""
    keys, seen = np.zeros(0, W.U), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def summed() -> tuple[np.ndarray, np.ndarray]:
        found, n = np.unique(np.concatenate(waiting), return_counts=True)
        both, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([seen, n])).astype(np.int64)

    for hashes, first, before, _ in parts:
        bounds = np.append(first, len(hashes))[before]
        waiting += [np.unique(hashes[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        if sum(map(len, waiting)) > STEP:
            keys, seen = summed()
            waiting = []
    if waiting:
        keys, seen = summed()
    return keys[(seen >= MIN_DOCUMENTS) & (keys != 0)]


def fit(parts: Callable[[], Iterator[tuple]], rounds: int = 150, penalty: float = 1.0, rate: float = 0.1) -> Model:
    """The model from the sampled documents, which are read twice.

    ``parts`` gives runs of documents: feature hashes, first words of sentences, sentences before each document, and labels.
    Documents without words take no part.
    """
    nothing = Model(np.zeros(0, W.U), np.zeros(1), -8.0)
    keys = _counted(parts())
    if not len(keys):
        return nothing
    columns, rows, counts, labels, shift = [], [], [], [], 0
    for hashes, first, before, label in parts():
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        known = keys[at] == hashes
        of = np.repeat(np.arange(shift, shift + len(first), dtype=np.int32), np.diff(np.append(first, len(hashes))))
        columns.append(at[known].astype(np.int32))
        rows.append(np.broadcast_to(of[:, None], at.shape)[known])
        counts.append(np.diff(before))
        labels.append(label)
        shift += len(first)
    at, sentence = np.concatenate(columns), np.concatenate(rows)
    del columns, rows
    counts, label = np.concatenate(counts), np.concatenate(labels).astype(float)
    counts, label = counts[counts > 0], label[counts > 0]
    owner = np.repeat(np.arange(len(label)), counts)
    weights, bias = np.zeros(len(keys)), -np.log(max(2.0, shift / max(1.0, label.sum())))
    state = [np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)]
    for turn in range(1, rounds + 1):  # Adam on the penalised likelihood
        logits = bias + np.bincount(sentence, weights[at], shift)
        mass = np.bincount(owner, np.logaddexp(0, logits), len(label))
        p = np.clip(-np.expm1(-mass), 1e-9, 1.0)
        pull = np.where(label > 0, -(1 - p) / p, 1.0)
        g = pull[owner] / (1 + np.exp(-np.clip(logits, -30, 30)))
        slope = np.append(np.bincount(at, g[sentence], len(keys)) + penalty * weights, g.sum())
        state = [0.9 * state[0] + 0.1 * slope, 0.99 * state[1] + 0.01 * slope**2]
        step = rate * (state[0] / (1 - 0.9**turn)) / (np.sqrt(state[1] / (1 - 0.99**turn)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    return Model(keys, np.append(weights, 0.0), float(bias))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.diff(W.spans(buf, offsets, _NOT_LETTER)[2]) for _, _, buf, offsets in W.slices(batch.column("content"))]
        sizes = pa.array(np.concatenate([np.zeros(0, np.int64), *counts]), pa.int64())
        columns = [batch.column("doc"), batch.column("label"), sizes, batch.column("content")]
        yield pa.RecordBatch.from_arrays(columns, names=["doc", "label", "n_words", "content"])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """The model from a bounded sample of labelled documents, in the order of a hash of the key.

    A document that does not fit into the bound of words is left out, and the ones after it are still looked at. Those of more than
    a ``SHARE``-th of the bound come after all others, so that no single row uses up the sample.
    Rows without a key or a label are left out; a key with several labels takes the largest.
    """
    order = F.xxhash64("doc", F.lit(11))
    known = labels.select(F.col(key).alias("doc"), F.col(label).cast("int").alias("label")).dropna()
    known = known.groupBy("doc").agg(F.max("label").alias("label")).orderBy(order, "doc").limit(MAX_DOCUMENTS)
    rows = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    sample = rows.join(F.broadcast(known), "doc")  # at most MAX_DOCUMENTS rows of two numbers
    made = sample.mapInArrow(_sized, "doc long, label int, n_words long, content string")
    made = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))  # written, so a row keeps its number
    sizes = made.select("row", "doc", "n_words", order.alias("o"), F.xxhash64("content").alias("w")).repartition(1)
    chosen = sizes.sortWithinPartitions("o", "doc", "w", "row").mapInArrow(_chosen(MAX_WORDS), "row long, place long")
    bounded = made.join(chosen, "row").select("label", "content", "place")
    fitted = bounded.repartition(1).sortWithinPartitions("place").mapInArrow(_fitted, "keys binary, weights binary, bias double")
    row = fitted.first()
    drop_written(docs.sparkSession, made)
    return Model(np.frombuffer(row.keys, W.U), np.frombuffer(row.weights), row.bias) if row else fit(lambda: iter(()))


def _chosen(most: int):
    """Numbers of the rows that fit into ``most`` words, and their places in the order; only numbers come to this one task."""

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [(b.column("row").to_numpy(), b.column("n_words").to_numpy()) for b in batches]
        if not table:
            return
        rows, sizes = (np.concatenate(c) for c in zip(*table, strict=True))
        is_long = sizes * SHARE > most
        kept, room = [], most
        for place in np.concatenate([np.flatnonzero(~is_long), np.flatnonzero(is_long)]):
            if sizes[place] <= room:
                room -= int(sizes[place])
                kept.append(place)
        kept = np.array(kept, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows[kept]), pa.array(kept)], names=["row", "place"])

    return do


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the bounded sample, fitted in one task, which holds its texts; only keys and weights reach the driver."""
    docs = [(batch.column("content"), batch.column("label").to_numpy()) for batch in batches]

    def parts() -> Iterator[tuple]:
        for texts, label in docs:
            for a, b, buf, offsets in W.slices(texts):
                yield *sentences(buf, offsets)[:3], label[a:b]

    if docs:
        model = fit(parts)
        columns = [pa.array([model.keys.tobytes()]), pa.array([model.weights.tobytes()]), pa.array([model.bias])]
        yield pa.RecordBatch.from_arrays(columns, names=["keys", "weights", "bias"])


def _scored(model: Model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.log(least / (1 - least))
        for batch in batches:
            scores, where = [], []
            for a, b, buf, offsets in W.slices(batch.column("content")):
                hashes, first, before, starts, ends = sentences(buf, offsets)
                logits = model.sentence_scores(hashes, first)
                scores.append(noisy_or(logits, before))
                found = [[] for _ in range(b - a)]
                bad = np.flatnonzero(logits >= floor)
                if len(bad):
                    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
                    last = np.append(first[1:], len(starts)) - 1
                    for s, d in zip(bad, np.searchsorted(before, bad, "right") - 1, strict=True):
                        zero = points[offsets[d]]
                        found[d].append((int(points[starts[first[s]]] - zero), int(points[ends[last[s]]] - zero)))
                where += [",".join(f"{x}:{y}" for x, y in f) for f in found]
            all_scores = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(all_scores), pa.array(where, pa.string())], names=["doc", "score", "offending"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", least: float = 0.3) -> DataFrame:
    """One row per row: key, ``score`` from 0 to 1, and ``offending`` sentences as start:end (code points, comma-joined).

    Whole texts are read; a text without words, empty or NULL, scores 0. Repeated rows and NULL keys come out once each; no rows
    give no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    return rows.mapInArrow(_scored(model, least), f"doc {kind}, score double, offending string").withColumnRenamed("doc", key)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", least: float = 0.3) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    model = train(docs, labels.where(~held_out(key)), text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, buf, offsets in W.slices(batch.column(text)):
                hashes, first, before, _, _ = sentences(buf, offsets)
                scores.append(noisy_or(model.sentence_scores(hashes, first), before))
            yield batch.filter(pa.array(np.concatenate(scores) < least))

    return docs.mapInArrow(run, docs.schema)


@REGISTRY.add("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "offending")
