"""Byte-pair encoding: a queue of merge ranks over a linked list of symbols, and decoding (operator 8).

Reads the vocabulary file of a public tokenizer (JSON with vocabulary and merges in rank order); nothing
is trained, and no tokenizer library is used here.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workload.registry import Registry
from . import words as W

REGISTRY = Registry()

# Fixed value: the pattern that splits text before merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of up to this many bytes are remembered, up to so many of them in each worker.
REMEMBERED_BYTES, REMEMBERED = 48, 300_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """The vocabulary, and the ids of texts."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self.vocabulary: dict[str, int] = parts["model"]["vocab"]
        self.letters = byte_letters()
        self.byte_ids = [self.vocabulary[c] for c in self.letters]
        self.ranks = {}
        for rank, (left, right) in enumerate(parts["model"]["merges"]):
            pair = self.vocabulary[left], self.vocabulary[right]
            self.ranks[pair] = rank, self.vocabulary[left + right]
        self.special = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        back = {c: b for b, c in enumerate(self.letters)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in self.vocabulary.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(PIECES)
        self.markers = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank is merged first, leftmost in ties.

        Symbols are a doubly linked list. The queue holds (rank, place, left, right) of pairs seen so far; an entry is
        stale, and skipped, when its two symbols are no longer neighbours as they were.
        """
        ids = [self.byte_ids[b] for b in piece]
        n, ranks = len(ids), self.ranks
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(*ranks[pair], i, *pair) for i in range(n - 1) if (pair := (ids[i], ids[i + 1])) in ranks]
        queue = [(rank, i, left, right, made) for rank, made, i, left, right in queue]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (found := ranks.get((made, ids[k]))) is not None:
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            if (h := before[i]) >= 0 and (found := ranks.get((ids[h], made))) is not None:
                heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def _packed(self, piece: str) -> bytes:
        packed = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= REMEMBERED_BYTES:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit numbers; special tokens' strings are those tokens."""
        out, get, packed = [], self.known.get, self._packed
        for i, part in enumerate(self.markers.split(text) if self.markers else [text]):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out += [get(p) or packed(p) for p in self.pieces.findall(part)]
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings of the ids one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def _encoded(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in W.portions(batches, "content"):
            ids = [bpe.encode(t or "") for t in batch.column("content").to_pylist()]
            columns = [batch.column("doc"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if back:
                columns.append(pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_tokens", "ids", "decoded"][: len(columns)])

    return run


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", back: bool = False) -> DataFrame:
    """Key, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) of every whole text; NULL is empty.

    One row per row, repeated keys and NULL keys too; an empty text has no ids. With ``back`` the ids are decoded again in
    the same pass, as ``decoded``. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.selectExpr(f"`{key}` AS doc", f"`{text}` AS content")
    schema = f"doc {kind}, n_tokens long, ids binary" + ", decoded string" * back
    return rows.mapInArrow(_encoded(path, back), schema).withColumnRenamed("doc", key)


def _decoded(path: str, ids: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in W.portions(batches, ids):
            texts = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` and the ``decoded`` text of its ``ids``; NULL ids give an empty text."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoded(path, ids), f"{schema}, decoded string")


@REGISTRY.add("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, back=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
