"""Periodic runs against a slow search of all periods and starts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from flightloom.llm import runs as R
from tests.llm.conftest import DOCS


def slow_runs(words, least=24, times=3):
    n, out = len(words), {}
    for q in range(1, n):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3) if n > 5 else 0):
        a = rng.randrange(n)
        p = rng.randrange(1, (n - a) // 3 + 2)
        for i in range(a, rng.randrange(a, n)):
            words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_find_runs_equals_slow_search(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = periodic(rng, rng.randrange(120), rng.choice([1, 2, 3, 30]))
        least, times = rng.choice([(24, 3), (24, 3), (5, 2), (9, 3), (1, 2)])
        assert R.find_runs(np.array(words, np.int32), least, times) == slow_runs(words, least, times)


def test_one_word_many_times_is_one_run():
    assert R.find_runs(np.zeros(20000, np.int32)) == [(0, 20000, 1)]


def slow_row(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    milli = 1000 * best[1] // best[2] if found else None
    return (doc_id, len(found), *best, milli, *(hashlib.sha256(t.encode()).hexdigest() for t in (lines, " ".join(kept))))


@pytest.fixture
def rows(corpus):
    rng = random.Random(3)
    short = [r[:2] for r in corpus if len(r[1] or "") < 3000]
    made = [(1000 + i, " ".join(f"w{w}" for w in periodic(rng, rng.randrange(10, 300), rng.choice([2, 5, 60])))) for i in range(60)]
    line = "the same line of eighteen words that comes again and again in a text of very many other words"
    made += [(2000, "\n".join([line] * 7)), (2001, "ab " * 25 + "\t" + "ab\x0bcd " * 20), (2002, " a " * 30), (2003, f"{line} x {line} y {line}")]
    return [(i, t, "en", "s", 0) for i, t in short + made]


def order(row):
    return str(row)


def test_query_equals_slow_rows(spark, rows, tmp_path):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    ours = R.op12_runs(spark, str(tmp_path))
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert ours.columns == names
    got = sorted((tuple(r) for r in ours.collect()), key=order)
    assert got == sorted((slow_row(r[0], r[1]) for r in rows), key=order)
    assert sum(r[1] > 0 for r in got) > 20


def test_odd_tables(spark, wide_docs, no_docs, corpus):
    out = R.periodic_runs(wide_docs)
    assert out.columns == ["doc_id", "runs", "collapsed"] and out.count() == len(corpus)
    assert R.periodic_runs(no_docs).count() == 0
    blank = [r for r in out.collect() if not (r.collapsed or "").strip()]
    assert blank and all(r.runs == [] and r.collapsed == "" for r in blank)
    text = out.where("doc_id IS NULL").collect()
    assert len(text) == 2
