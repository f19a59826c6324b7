"""Packing documents into token sequences: cutting stock by column generation (operator 3).

Documents are cut into full sequences and one rest. The rests' lengths, in units of a few tokens, make a histogram whose
size does not grow with the data. A linear program over patterns (how many rests of each length fill one
sequence) is solved on it; a knapsack by dynamic programming finds the pattern that the current prices
value most. Rounded patterns are then dealt out to the ranked documents of each length in a distributed way.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry
from . import words as W
from .bpe import byte_letters

REGISTRY = Registry()

#: Tokens in a unit of the histogram: a sequence wastes less than this per piece.
UNIT = 8
#: Pieces of words, and words in other letters, whose ids a worker remembers, in each of two generations (and those of one portion of texts more); about
#: 150 bytes each.
REMEMBERED = 100_000
#: Texts of these letters only are cut and lower-cased here: composed letters, the same in all versions of Unicode.
PLAIN = r"[\t-\r -~\u00a1-\u012f\u0131-\u017f]*+"
# Letters and numbers among them, in the lower case; and the tokenizer's pattern for pieces, said in these.
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES = f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^\\s{_LETTERS}{_NUMBERS}]+"
#: Pieces of one rank window.
WINDOW = 20_000


class Remembered:
    """Ids by text in two generations; the older one goes when the newer one is full."""

    def __init__(self, make) -> None:
        self.make, self.known, self.older = make, {}, {}

    def learn(self, texts: set[str]) -> dict[str, bytes]:
        """A table that has all of ``texts``; ``make`` gets those that are not remembered."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        new = texts.difference(self.known)
        back = [t for t in new if t in self.older]
        self.known.update((t, self.older[t]) for t in back)
        new = list(new.difference(back))
        self.known.update(zip(new, self.make(new), strict=True))
        return self.known


class WordIds:
    """Ids of texts by a public tokenizer whose tokens never reach over white space or its pieces, piece by piece and remembered.

    Texts in the letters of ``PLAIN`` are cut here, and the tokenizer's model only gets new pieces. Other texts go word by word, and
    their words with other letters through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.cut, self.plain, self.letters = re.compile(PIECES).findall, re.compile(PLAIN).fullmatch, byte_letters()
        self.pieces, self.words = Remembered(self._of_pieces), Remembered(self._of_words)

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        spelt = [p if p.isascii() else "".join([self.letters[b] for b in p.encode()]) for p in pieces]
        return [array("I", [t.id for t in self.model.tokenize(p)]).tobytes() for p in spelt]

    def _of_words(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def _is_plain(self, text: str) -> bool:
        return self.plain(text) is not None and "<|" not in text

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut: list[list[str]] = []
        odd: set[str] = set()
        for text in texts:
            if self._is_plain(text):
                cut.append(self.cut(text.lower()))
                continue
            pieces: list[str] = []
            for word in text.replace("\n", " ").split(" "):
                if self._is_plain(word):
                    pieces += self.cut(word.lower())
                elif word:
                    pieces.append(word)
                    odd.add(word)
            cut.append(pieces)
        known = self.pieces.learn(set().union(*cut) - odd)
        if not odd:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        strange = self.words.learn(odd)
        return [b"".join([strange[p] if p in odd else known[p] for p in pieces]) for pieces in cut]


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One tokenizer per worker process."""
    return WordIds(path)


def _cut(path: str, end_id: int, size: int):
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for batch in W.portions(batches, "content"):
            at, start, length, crc, total, ids = [], [], [], [], [], []
            for row, tokens in enumerate(encode([t or "" for t in batch.column("content").to_pylist()])):
                tokens += last
                for begin in range(0, len(tokens), 4 * size):
                    piece = tokens[begin : begin + 4 * size]
                    at.append(row)
                    start.append(begin // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(tokens) // 4)
                    ids.append(piece)
            columns = [batch.column("doc").take(pa.array(at, pa.int32()))]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.binary())], names=["doc", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Written table of pieces with their ids and a number of their own, ``piece``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    cut = rows.mapInArrow(_cut(path, end_id, size), f"doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    return cut_lineage(cut.withColumn("piece", F.monotonically_increasing_id()))


def knapsack(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of ``room`` with any number of items of each size."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for r in range(int(sizes[0]), room + 1):
        gain = values[: fits[r]] + best[r - sizes[: fits[r]]]
        i = int(gain.argmax())
        if gain[i] > best[r - 1]:
            best[r], took[r] = gain[i], i
        else:
            best[r] = best[r - 1]
    counts, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            counts[took[r]] += 1
            r -= int(sizes[took[r]])
    return float(best[room]), counts


def patterns(demand: np.ndarray, sizes: np.ndarray, room: int, close: float = 5e-4, most: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, so that all of ``demand`` has a place.

    Revised simplex with generated columns: prices from the basis, the knapsack's best pattern enters, until none is worth more
    than 1 + ``close``, which bounds the distance to the optimum (or after ``most`` columns). Whole parts
    of the solution are kept; what rounding leaves over, less than a sequence per pattern, is filled in first-fit
    decreasing order.
    """
    if not len(sizes):
        return []
    basis = np.diag(room // sizes).astype(float)
    inverse, amount = np.diag(1.0 / np.diag(basis)), demand / np.diag(basis)
    for _ in range(most):
        value, column = knapsack(np.maximum(inverse.sum(axis=0), 0.0), sizes, room)
        if value <= 1 + close:
            break
        way = inverse @ column
        up = way > 1e-9
        ratio = np.full(len(way), np.inf)
        ratio[up] = np.maximum(amount[up], 0) / way[up]
        out = int(ratio.argmin())
        amount = amount - ratio[out] * way
        amount[out] = ratio[out]
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    left, used = demand.astype(np.int64).copy(), []
    for i in np.argsort(-amount):
        column = np.rint(basis[:, i]).astype(np.int64)
        need = column > 0
        times = min(int(np.floor(amount[i] + 1e-6)), int((left[need] // column[need]).min()))
        if times > 0:
            used.append((column, times))
            left -= times * column
    used += first_fit(left, sizes, room)
    return used


def first_fit(left: np.ndarray, sizes: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Fills sequences one kind at a time with the largest items that fit; as many alike at once as there are items for."""
    left, used = left.copy(), []
    while left.any():
        column, free = np.zeros(len(left), np.int64), room
        for i in range(len(sizes) - 1, -1, -1):
            take = min(int(left[i]), free // int(sizes[i]))
            column[i] = take
            free -= take * int(sizes[i])
        need = column > 0
        times = int((left[need] // column[need]).min())
        used.append((column, times))
        left -= times * column
    return used


@dataclass
class Plan:
    """For each length class, ranges of ranks: where they begin, how many of a pattern's places they fill, and its sequences."""

    ranges: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int


def plan(counts: dict[int, int], room: int) -> Plan:
    """From the number of pieces per length class (in units) to ranges of ranks."""
    sizes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[int(s)] for s in sizes], np.int64)
    parts: dict[int, list[tuple[int, int, int, int]]] = {int(s): [] for s in sizes}
    done, first = np.zeros(len(sizes), np.int64), 0
    for column, times in patterns(demand, sizes, room):
        place = 0
        for i in np.flatnonzero(column)[::-1]:
            parts[int(sizes[i])].append((int(done[i]), int(column[i]), first, place))
            done[i] += column[i] * times
            place += int(column[i])
        first += times
    return Plan({s: tuple(np.array(c, np.int64) for c in zip(*p, strict=True)) for s, p in parts.items()}, first)


def _dealt(deal: Plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            units, rank = frame["units"].to_numpy(), frame["rank"].to_numpy()
            sequence, place = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            for s in np.unique(units):
                rows = units == s
                begin, each, first, where = deal.ranges[int(s)]
                k = np.searchsorted(begin, rank[rows], "right") - 1
                local = rank[rows] - begin[k]
                sequence[rows] = first[k] + local // each[k]
                place[rows] = where[k] + local % each[k]
            yield frame.drop(columns=["units", "rank"]).assign(sequence_id=sequence, place=place)

    return run


def assign(cut: DataFrame, size: int = 4096, unit: int = UNIT) -> DataFrame:
    """``cut`` without ids, with ``sequence_id`` and ``offset``: pieces of a sequence follow each other without gaps.

    Pieces of a length class are ranked in hash buckets of about ``WINDOW`` rows, as many as the class needs, and the buckets by
    their sizes, so a length that a third of all documents share is never in one task.
    """
    rows = cut.drop("ids").withColumn("units", F.ceil(F.col("length") / unit).cast("int"))
    # One row per length class; a class gets as many buckets as its own rows need.
    counts = {r["units"]: r["n"] for r in rows.groupBy("units").agg(F.count("*").alias("n")).collect()}
    slots = F.element_at(F.create_map(*[F.lit(x) for s, n in sorted(counts.items()) for x in (s, -(-n // WINDOW))]), F.col("units"))
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("piece"), slots).cast("int") if counts else F.lit(0))
    sizes = cut_lineage(rows.groupBy("units", "slot").agg(F.count("*").alias("n")))
    deal = plan(counts, size // unit)
    before = sizes.withColumn("before", F.expr("sum(n) OVER (PARTITION BY units ORDER BY slot) - n")).drop("n")
    ranked = rows.withColumn("own", F.expr("row_number() OVER (PARTITION BY units, slot ORDER BY piece) - 1"))
    ranked = ranked.join(before, ["units", "slot"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "slot")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name not in ("units", "rank"))
    dealt = ranked.mapInPandas(_dealt(deal), f"{kinds}, sequence_id long, place long")
    return dealt.withColumn("offset", F.expr("sum(length) OVER (PARTITION BY sequence_id ORDER BY place) - length")).drop("place")


def pack(docs: DataFrame, path: str, end_id: int = 2, size: int = 4096, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, ``start``, ``length``, ``ids``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids end with ``end_id``; NULL and empty texts are that id alone. A piece is a full sequence or the rest of a
    document, so every id is in exactly one piece. Repeated rows and NULL keys are packed like others; no rows
    give no rows. Other columns are not read.
    """
    cut = pieces(docs, path, end_id, size, text, key)
    return assign(cut, size).join(cut.select("piece", "ids"), "piece").drop("piece").withColumnRenamed("doc", key)


@REGISTRY.add("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return assign(cut).select(F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
