"""Cross-entropy difference of two n-gram models (operator 5).

A target model is counted on documents of the wanted kind, a background model on all documents. Both are bigram models with
one vocabulary, one smoothing and one set of events, so that their per-token losses can be subtracted: a low
score marks a document that the target model expects better than the background model does.

The counts of bigrams and words grow with the corpus and are shuffled, never broadcast; all words count. A task packs its documents
into pieces of about ``CHUNK`` tokens, each piece asks for the counts of its distinct bigrams and words, and is scored with the
answers. What is asked travels as sorted 64-bit codes of bigrams by ranges of codes, and an answer is what other pieces add to
the piece's own counts, in the order of the question: nothing for a bigram that lives in one piece, as most do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry
from . import words as W

REGISTRY = Registry()

#: Ids of the unknown word, the begin and the end; all other ids are hashes of words.
UNKNOWN, BEGIN, END = (int(x) for x in W.seeds(3, 900).view(np.int64))
#: Tokens of a piece, and of a range of codes.
CHUNK = 1_000_000
#: Weight of the bigram's own frequency, and what is added to each word's count.
BIGRAM_WEIGHT, ADDED = 0.6, 0.5


def _hashed(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    table = W.letters(True)
    for a, b, buf, offsets in W.slices(column):
        starts, ends, before = W.spans(buf, offsets)
        yield b - a, W.word_hashes(buf, starts, ends, table), before


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, hashes, _ in _hashed(batch.column("content")):
            found, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])


def vocabulary(rows: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the most frequent words; ``size`` numbers at most reach the driver."""
    counts = rows.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size).select("word").toPandas()["word"]
    return np.sort(top.to_numpy(np.int64).view(W.U))


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers as their lowest bytes, then their second ones, up to the last that any of them needs, compressed."""
    planes = max(1, -(-int(values.max()).bit_length() // 8))
    data = values.astype(W.U).view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()
    return bytes([planes]) + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd"), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(W.U).ravel()


def _pieces(chunk: int):
    """Documents of a task in runs of about ``chunk`` tokens; a row holds their compressed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for a, b, buf, offsets in W.slices(batch.column("content"), min(W.STEP, 8 * chunk)):
                events = np.diff(W.spans(buf, offsets)[2]) + 1
                waiting.append((batch.column("doc").slice(a, b - a), buf, np.diff(offsets), events))
                size += int(events.sum())
                if size >= chunk:
                    yield _piece(waiting)
                    waiting, size = [], 0
        if waiting:
            yield _piece(waiting)

    return run


def _piece(waiting: list[tuple]) -> pa.RecordBatch:
    docs, sizes = pa.concat_arrays([w[0] for w in waiting]), pa.array(np.concatenate([w[2] for w in waiting]), pa.int64())
    data = b"".join(w[1].tobytes() for w in waiting)
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (docs, sizes)]
    numbers = [pa.array([n], pa.int64()) for n in (len(data), sum(int(w[3].sum()) for w in waiting))]
    text = pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)
    return pa.RecordBatch.from_arrays([*lists, *numbers, pa.array([text], pa.binary())], names=["docs", "sizes", "n_bytes", "n_events", "text"])


def _wanted(n: int, places: list[int]) -> np.ndarray:
    out = np.zeros(n, bool)
    out[places] = True
    return out


def _opened(sizes: list[int], n_bytes: int, text: bytes, words: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words of a piece, and how many each text has."""
    data = pa.decompress(text, n_bytes, "zstd", asbytes=True)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    ids, counts = [np.zeros(0, W.U)], [np.zeros(0, np.int64)]
    for _, hashes, before in _hashed(column):
        ids.append(hashes if words is None else np.where(np.isin(hashes, words), hashes, np.int64(UNKNOWN).view(W.U)))
        counts.append(np.diff(before))
    return np.concatenate(ids), np.concatenate(counts)


def events(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both words of the bigrams of all texts, each with a begin before its words and an end after them."""
    text = np.arange(len(counts))
    after = np.cumsum(counts)
    line = np.empty(len(ids) + 2 * len(counts), np.int64)
    line[np.arange(len(ids)) + 2 * np.repeat(text, counts) + 1] = ids.view(np.int64)
    line[after - counts + 2 * text] = BEGIN
    line[after + 2 * text + 1] = END
    inside = np.ones(len(line), bool)
    inside[after + 2 * text + 1] = False
    return line[inside], line[1:][inside[:-1]]


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(first.view(W.U)) + second.view(W.U))


def _starts(buckets: int) -> np.ndarray:
    """The least code of each range."""
    return np.arange(buckets, dtype=W.U) * W.U((2**64 - 1) // buckets)


def _asked(buckets: int, words: np.ndarray | None):
    """Distinct codes of each piece by range, and how often they are in its documents and in its target documents."""
    starts = _starts(buckets)

    def run(pieces: pa.Table, marks: pa.Table) -> pa.Table:
        row = pieces.to_pylist()[0]
        ids, counts = _opened(row["sizes"], row["n_bytes"], row["text"], words)
        wanted = _wanted(len(counts), [x for m in marks.column("wanted").to_pylist() for x in m])
        out: list[list] = [[] for _ in range(6)]
        for is_word, all_codes, of in ((True, ids, counts), (False, pair_codes(*events(ids, counts)), counts + 1)):
            codes, at, n = np.unique(all_codes, return_inverse=True, return_counts=True)
            t = np.bincount(at, np.repeat(wanted, of), len(codes))
            bounds = np.append(np.searchsorted(codes, starts), len(codes))
            for bucket in np.flatnonzero(np.diff(bounds)).tolist():
                low, high = bounds[bucket], bounds[bucket + 1]
                steps = np.diff(codes[low:high], prepend=starts[bucket])
                for column, value in zip(out, (row["piece"], bucket, is_word, packed(steps), packed(n[low:high]), packed(t[low:high])), strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["piece", "bucket", "word", "codes", "n", "t"])

    return run


def _answered(buckets: int):
    starts = _starts(buckets)

    def run(table: pa.Table) -> pa.Table:
        return _others(table, starts[table.column("bucket")[0].as_py()])

    return run


def _others(table: pa.Table, start: np.uint64) -> pa.Table:
    """What the other pieces add to the counts of each piece of one range of codes; in one row, the number of codes and their count in target documents."""
    lists = [np.cumsum(unpacked(c), dtype=W.U) + start for c in table.column("codes").to_pylist()]
    codes, at = np.unique(np.concatenate(lists), return_inverse=True)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    out = {c: table.column(c) for c in ("piece", "bucket", "word")}
    rest = [0] * (len(lists) - 1)
    for name in ("n", "t"):
        own = np.concatenate([unpacked(x) for x in table.column(name).to_pylist()]).astype(np.int64)
        others = np.bincount(at, own, len(codes)).astype(np.int64)[at] - own
        out[name] = pa.array([packed(x) for x in np.split(others, cuts)], pa.binary())
    return pa.table(out | {"kinds": pa.array([len(codes), *rest], pa.int64()), "target": pa.array([int(own.sum()), *rest], pa.int64())})


def losses(pair: np.ndarray, first: np.ndarray, second: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """Losses of bigrams, from their own counts and those of their words (as first ones of bigrams, and as second ones)."""
    base = (second + ADDED) / (total + ADDED * kinds)  # every word but the begin
    own = np.where(first > 0, pair / np.maximum(first, 1), base)
    return -np.log(BIGRAM_WEIGHT * own + (1 - BIGRAM_WEIGHT) * base)


def _scored(sums: dict[str, int], kinds: int, words: np.ndarray | None):
    def run(pieces: pa.Table, answers: pa.Table) -> pa.Table:
        piece = pieces.to_pylist()[0]
        ids, counts = _opened(piece["sizes"], piece["n_bytes"], piece["text"], words)
        first, second = events(ids, counts)
        rows = answers.to_pylist()
        wanted = _wanted(len(counts), [x for r in rows for x in r["wanted"] or []])
        codes, index, at = np.unique(pair_codes(first, second), return_index=True, return_inverse=True)
        names, where = np.unique(ids, return_inverse=True)
        others: dict = {(w, c): [np.zeros(0, W.U)] for w in (False, True) for c in ("n", "t")}
        for row in sorted((r for r in rows if r["wanted"] is None), key=lambda r: r["bucket"]):
            for c in ("n", "t"):
                others[row["word"], c].append(unpacked(row[c]))
        bounds = np.concatenate([[0], np.cumsum(counts + 1)])
        out = {"doc": pieces.column("docs").combine_chunks().flatten(), "n_tokens": pa.array(counts.astype(np.int64))}
        for name, c in (("target_loss", "t"), ("background_loss", "n")):
            own, mine = (np.repeat(wanted, x) if c == "t" else None for x in (counts + 1, counts))
            pair = np.bincount(at, own, len(codes)) + np.concatenate(others[False, c])
            word = np.append(np.bincount(where, mine, len(names)) + np.concatenate(others[True, c]), sums[f"{c}_docs"])
            sides = []
            for side, edge in ((first[index], BEGIN), (second[index], END)):
                place = np.where(side == edge, len(names), np.searchsorted(names, side.view(W.U)))
                sides.append(word[place])
            each = losses(pair, *sides, sums[c], kinds)[at]
            out[name] = pa.array(np.add.reduceat(each, bounds[:-1]) / (counts + 1))
        return pa.table(out)

    return run


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", size: int | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One row per document: key, ``n_tokens``, ``target_loss``, ``background_loss`` and ``score``, their difference, per token.

    ``target`` holds the keys of the target documents; a key counts once however often it is there. Words end at white space, A-Z
    is lower-cased. P(b | a) = w * c(ab) / c(a) + (1 - w) * (c(b) + d) / (N + d * words), over the words of a whole text with a
    begin and an end; all words count, or with ``size`` the most frequent ones and the others as one. An empty or NULL text is the one event begin-end. With no target documents the target model is uniform.
    Bigrams are told apart by 64 bits.
    Rows that repeat a key and rows with a NULL key come out once each; no rows give no rows; other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    words = None if size is None else vocabulary(rows, size)
    made = rows.mapInArrow(_pieces(chunk), f"docs array<{kind}>, sizes array<long>, n_bytes long, n_events long, text binary")
    pieces = cut_lineage(made.withColumn("piece", F.monotonically_increasing_id()))  # written, so a piece keeps its number
    places = pieces.select("piece", F.posexplode("docs").alias("at", "doc"))  # keys are joined without their texts
    marks = places.join(target.select(F.col(key).alias("doc")).distinct(), "doc", "left_semi").groupBy("piece")
    marks = cut_lineage(marks.agg(F.collect_list("at").alias("wanted")))
    total, n_docs = (x or 0 for x in pieces.agg(F.sum("n_events"), F.sum(F.size("docs"))).first())
    t_docs = marks.agg(F.sum(F.size("wanted"))).first()[0] or 0

    buckets = max(1, -(-total // chunk))
    texts = pieces.select("piece", "docs", "sizes", "n_bytes", "text").groupBy("piece")
    asked = texts.cogroup(marks.groupBy("piece")).applyInArrow(_asked(buckets, words), "piece long, bucket int, word boolean, codes binary, n binary, t binary")
    answers = asked.groupBy("bucket", "word").applyInArrow(_answered(buckets), "piece long, bucket int, word boolean, n binary, t binary, kinds long, target long")
    answers = cut_lineage(answers)
    known, tokens = (x or 0 for x in answers.where("word").agg(F.sum("kinds"), F.sum("target")).first())
    sums = {"n": total, "t": tokens + t_docs, "n_docs": n_docs, "t_docs": t_docs}
    kinds = (known if words is None else len(words)) + 2  # and the unknown word and the end
    answers = answers.drop("kinds", "target").unionByName(marks, allowMissingColumns=True)
    scored = texts.cogroup(answers.groupBy("piece")).applyInArrow(
        _scored(sums, kinds, words), f"doc {kind}, n_tokens long, target_loss double, background_loss double"
    )
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("doc", key)


@REGISTRY.add("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return cross_entropy_difference(docs, good)
