"""Personal data: strict patterns, and weakly supervised spans beside them (operator 7).

Strict patterns give the base spans, which always stay. Looser patterns propose further spans. Labelers (pattern,
checksum, gazetteer, words before, glued letters) vote on every proposal; expectation-maximisation over the counts of
vote patterns of all documents estimates how reliable each labeler is and what each proposal probably is; a
logistic model of the span's own features is trained on these probabilities and decides on proposals that are
no base span. All that training needs is a table of counts whose size is bounded by the numbers of
vote patterns and feature cells, whatever the size of the corpus.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..workload.registry import Registry
from . import words as W

REGISTRY = Registry()

KINDS = ("email", "ip", "card", "phone", "id")
# The strict patterns. A look-behind only skips starts inside a run of digits, which can't match either.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser patterns.
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|@| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot |\.) ?[A-Za-z0-9-]{2,63}){1,4}")
SIX = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")
PERSON_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
# Gazetteers and words before a span.
ENDINGS = frozenset("com org net edu gov info io de fr es it nl uk eu us ch at be pl se".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 52 55 61 81 86 91".split())
FOR_IT = re.compile(r"(?i)(e-?mail|mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|ip|address|host|server|ssn|social|kontakt|correo|courriel)\W{0,8}$")
AGAINST = re.compile(r"(?i)(version|ver|order|invoice|isbn|issn|serial|ticket|commit|build|item|part|no|nr|rev|doi)\W{0,8}$")

VOTERS = ("pattern", "checksum", "gazetteer", "words", "glued")
#: How many values each feature has.
FEATURES = (len(KINDS), 5, 4, 2, 2, 2, 2)
CONTEXT = 24


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict patterns, leftmost and non-overlapping within a kind, failing matches dropped."""
    out = []
    if "@" in text:
        free = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                free = m.end()
    out += [(1, *m.span()) for m in IP.finditer(text) if octets(m.group())]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the looser patterns."""
    out = []
    if any(x in text for x in ("@", " at ", "(at)", "[at]")) and ("." in text or "dot" in text):
        out += [(0, *m.span()) for m in SPELT.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text)]
    if ":" in text:
        out += [(1, *m.span()) for m in SIX.finditer(text)]
    out += [(2, *m.span()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(digits(m.group())) <= 19]
    out += [(3, *m.span()) for m in LOCAL_PHONE.finditer(text)]
    out += [(4, *m.span()) for m in PERSON_ID.finditer(text)]
    return out


def described(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, int]:
    """Code of the votes (0 against, 1 none, 2 for each), and code of the features."""
    span, before = text[start:end], text[max(0, start - CONTEXT) : start]
    number = digits(span)
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    if kind == 0:
        check, known = 1, 2 if re.split(r"[^A-Za-z]+", span)[-1].lower() in ENDINGS else 0
    elif kind == 1:
        check, known = (2 if ":" in span or octets(span) else 0), 1
    elif kind == 2:
        check, known = (2 if luhn(number) else 0), (2 if number[0] in "3456" else 1)
    elif kind == 3:
        check, known = (2 if 9 <= len(number) <= 15 else 0), (2 if not span.startswith("+") or any(number[:i] in CALLING for i in (1, 2)) else 1)
    else:
        check, known = (0 if number[:3] in ("000", "666") or number[0] == "9" else 1), 1
    for_it, against = bool(FOR_IT.search(before)), bool(AGAINST.search(before))
    votes = (2 if base else 1, check, known, 2 if for_it else 0 if against else 1, 0 if glued else 1)
    separators = 0 if span.isalnum() else 1 if " " in span else 2 if "-" in span else 3
    features = (kind, min(4, len(span) // 6), separators, int(check == 0), int(for_it), int(against), int(glued))
    code = 0
    for value, size in zip(features, FEATURES, strict=True):
        code = code * size + value
    return sum(v * 3**i for i, v in enumerate(votes)), code


def examine(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, int]]]:
    """Base spans, and (kind, start, end, votes, features) of base spans and of proposals that overlap none."""
    base = sorted(base_spans(text))
    out = [(*s, *described(text, *s, True)) for s in base]
    taken = sorted((start, end) for _, start, end in base)
    ends = list(np.maximum.accumulate([e for _, e in taken])) if taken else []
    starts = [s for s, _ in taken]
    last = {}
    for kind, start, end in sorted(proposals(text), key=lambda s: (s[0], s[1], -s[2])):
        i = bisect.bisect_left(starts, end)
        if (i and ends[i - 1] > start) or last.get(kind, -1) > start:
            continue
        last[kind] = end
        out.append((kind, start, end, *described(text, kind, start, end, False)))
    return base, out


_SPANS = "array<struct<kind:int,start:int,stop:int,votes:int,features:int>>"
_SPANS_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("kind", "start", "stop", "votes", "features")]))


def _examined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _SPANS_ARROW.value_type]
    for batch in W.portions(batches, "content"):
        found = [examine(t or "") for t in batch.column("content").to_pylist()]
        spans = pa.array([[dict(zip(names, s, strict=True)) for s in all_spans] for _, all_spans in found], _SPANS_ARROW)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(b) for b, _ in found], pa.int32()), spans], names=["doc", "n_base", "spans"])


@dataclass
class Model:
    """Reliabilities of the labelers, the weights of the final classifier, and the feature codes it accepts."""

    reliabilities: np.ndarray  # voter, class, vote
    weights: np.ndarray
    threshold: float

    def accepts(self, features: int) -> bool:
        return self.probability(np.array([features]))[0] >= self.threshold

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(one_hot(features) @ self.weights)))


def one_hot(codes: np.ndarray) -> np.ndarray:
    out = np.ones((len(codes), 1 + sum(FEATURES)))
    at, rest = 1 + sum(FEATURES), np.asarray(codes, np.int64)
    for size in reversed(FEATURES):
        at -= size
        out[:, at : at + size] = (rest % size)[:, None] == np.arange(size)
        rest = rest // size
    return out


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: how each voter votes on true and on false spans, and how probably each pattern is true."""
    cast = np.stack([votes // 3**i % 3 for i in range(len(VOTERS))], axis=1)
    true = np.clip(0.5 + 0.2 * (cast - 1).sum(axis=1), 0.05, 0.95)
    likely = np.zeros((len(VOTERS), 2, 3))
    for _ in range(rounds):
        for side, share in ((0, counts * (1 - true)), (1, counts * true)):
            for j in range(len(VOTERS)):
                seen = np.bincount(cast[:, j], share, 3) + 0.5
                likely[j, side] = seen / seen.sum()
        prior = (counts @ true + 1) / (counts.sum() + 2)
        odds = np.log(prior) - np.log(1 - prior)
        odds = odds + sum(np.log(likely[j, 1, cast[:, j]]) - np.log(likely[j, 0, cast[:, j]]) for j in range(len(VOTERS)))
        true = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return likely, true


def fit(votes: np.ndarray, features: np.ndarray, counts: np.ndarray, threshold: float = 0.5, penalty: float = 1.0) -> Model:
    """The model from counts per (votes, features)."""
    if not len(counts):
        return Model(np.full((len(VOTERS), 2, 3), 1 / 3), np.r_[-5.0, np.zeros(sum(FEATURES))], threshold)
    counts = counts.astype(float)
    likely, true = reliabilities(votes, counts)
    x, scale = one_hot(features), counts / counts.mean()
    weights = np.zeros(x.shape[1])
    for _ in range(30):  # Newton's steps of the penalised logistic model
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (scale * (p - true)) + penalty * weights
        curve = (x * (scale * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, slope)
    return Model(likely, weights, threshold)


def examined(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc``, ``n_base`` and all spans with votes and features, written once; the first ``n_base`` spans are the base."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("content"))
    return cut_lineage(rows.mapInArrow(_examined, f"doc {kind}, n_base int, spans {_SPANS}"))


def train(found: DataFrame, threshold: float = 0.5) -> Model:
    """The model from all spans of ``examined``: only counts per vote pattern and feature cell reach the driver."""
    cells = found.select(F.explode("spans").alias("s")).groupBy("s.votes", "s.features").agg(F.count("*").alias("n")).orderBy("votes", "features")
    table = cells.toPandas()
    return fit(table["votes"].to_numpy(np.int64), table["features"].to_numpy(np.int64), table["n"].to_numpy(np.int64), threshold)


def _decided(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, bool] = {}
        for batch in batches:
            base, added = [], []
            for n, spans in zip(batch.column("n_base").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                plain = [(s["kind"], s["start"], s["stop"], s["features"]) for s in spans]
                for s in plain[n:]:
                    if s[3] not in known:
                        known[s[3]] = model.accepts(s[3])
                base.append(said(s[:3] for s in plain[:n]))
                added.append(said(s[:3] for s in plain[n:] if known[s[3]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(base, pa.string()), pa.array(added, pa.string())], names=["doc", "base", "added"])

    return run


def said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per row: key, ``base`` and ``added`` spans as kind:start:end, by kind and start; code points, end exclusive.

    NULL and empty texts have no spans, whole texts are read, repeated rows and NULL keys come out once each, no rows give no
    rows, and other columns are not read.
    """
    found = examined(docs, text, key)
    kind = docs.schema[key].dataType.simpleString()
    return found.mapInArrow(_decided(train(found, threshold)), f"doc {kind}, base string, added string").withColumnRenamed("doc", key)


def masked(text: str, model: Model) -> str:
    """The text with every base span and every accepted proposal replaced by its kind in brackets."""
    base, spans = examine(text)
    keep = sorted((a, b, k) for n, (k, a, b, _, features) in enumerate(spans) if n < len(base) or model.accepts(features))
    out, at = [], 0
    for a, b, k in keep:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """All rows and columns, personal data in the text replaced by its kind. NULL texts stay NULL."""
    model = train(examined(docs, text, key), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.portions(batches, text):
            at = batch.schema.get_field_index(text)
            clean = [t if t is None else masked(t, model) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, added = batch.column("base").to_pylist(), batch.column("added").to_pylist()
        parts = [[s.split(":")[0] for s in b.split(",")] if b else [] for b in base]
        counts = [pa.array([p.count(k) for p in parts], pa.int64()) for k in KINDS[:4]]
        order = lambda s: (KINDS.index((x := s.split(":"))[0]), int(x[1]))
        spans = [",".join(sorted(filter(None, [*b.split(","), *a.split(",")]), key=order)) for b, a in zip(base, added, strict=True)]
        digest = [sha256(b.encode()).hexdigest() for b in base]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digest), pa.array(spans, pa.string())], names=names)


@REGISTRY.add("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(
        _digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )
