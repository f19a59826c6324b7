"""Top-k search and repeated passages against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flightloom.llm import substrings, top_k, words


def vectors():
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]
    rows += [(400, None), (401, [0.1, None]), (402, [math.nan] * 24), (403, [math.inf, 1.0]), (None, [1.0]), (404, [0.5]), (405, []), (0, rows[0][1])]
    return rows


def brute_top(rows, every, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in whole if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize(("k", "step"), [(5, 8), (3, 24), (500, 5)])
def test_top_k(spark, k, step):
    rows = vectors()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, ids string, score int")
    got = top_k.top_k(df, F.col("id") % 50 == 0, k, block=64, query_block=3, step=step).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 50, k) and len(got) == len(set(got))


def test_top_k_of_large_numbers_and_without_rows(spark):
    rows = [(0, [1e12, -3.0]), (1, [1e12, 5.0]), (2, [-1e12, 1.0]), (3, [1e300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k.top_k(df, F.col("id") == 0, 3).collect()}
    assert got[0, 1][0] in (1, 3) and got[0, 3][0] == 2
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k.top_k(none, F.col("id") == 0).count() == 0


def test_queries_of_all_blocks_do_not_go_to_the_driver(spark):
    """The planner takes the queries, repeated for each block, for a small table."""
    df = spark.createDataFrame([(i, [i % 7 / 8, i % 5 / 8]) for i in range(200)], "vec_id long, embedding array<double>")
    found = top_k.top_k(df, F.col("id") % 2 == 0, 3, block=8, query_block=16)
    assert found.count() == 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bounds_keep_all_of_the_best():
    rng = np.random.default_rng(0)
    columns = np.vstack([rng.integers(-50, 50, (8, 500)), rng.integers(-2, 3, (24, 500))]).astype(np.int64)
    for q, ids, scores in top_k.search_block(np.arange(500), columns, np.arange(20), columns[:, :20].copy(), 5, 8):
        exact = (columns[:, q] @ columns).astype(float)
        exact[q] = -np.inf
        order = np.lexsort((np.arange(500), -exact))[:5]
        assert ids.tolist() == order.tolist() and list(scores) == exact[order].tolist()


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_repeated_passages(wide_docs, corpus):
    words = {k: words_of(t) for k, t, *_ in corpus if k is not None}
    runs = {}
    for k, w in words.items():
        for i in range(len(w) - 49):
            runs.setdefault(tuple(w[i : i + 50]), set()).add(k)
    want = {k for ks in runs.values() if len(ks) > 1 for k in ks}
    got = substrings.repeated_passages(wide_docs).collect()
    assert want <= {r.doc_id for r in got}
    for r in got:
        a, b = words[r.doc_id][r.start : r.stop], words[r.other_id][r.other_start : r.other_stop]
        left, right = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert len(a) >= 50 and len(left & right) >= 0.8 * len(left | right) and r.doc_id != r.other_id


def test_passages_hidden_by_a_common_part(spark):
    """All share 34 words, only some pairs share a whole passage: the hubs fail, the pairs are found."""
    rng = random.Random(8)
    part = [f"c{i}" for i in range(34)]
    texts = []
    for i in range(30):
        own = [f"p{i // 2}_{j}" for j in range(40)] if i < 8 else [f"q{i}_{j}" for j in range(40)]
        texts.append(" ".join([f"r{rng.random()}" for _ in range(20)] + part + own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in substrings.repeated_passages(df).collect()}
    assert {frozenset(p) for p in got} == {frozenset((2 * i, 2 * i + 1)) for i in range(4)}


def test_passages_without_rows(no_docs):
    assert substrings.repeated_passages(no_docs).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_running_least(repeated):
    rng = np.random.default_rng(5)
    for n, run in ((7, 7), (50, 6), (46, 46), (200, 46)):
        values = words.mix(rng.integers(0, 9 if repeated else 2**60, n).astype(np.uint64))
        want = [i + int(np.argmin(values[i : i + run])) for i in range(n - run + 1)]
        assert substrings.running_least(values, run).tolist() == want


def alike(a, b):
    left, right = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(left & right) >= 0.8 * len(left | right)


def test_passages_with_few_common_signatures(spark):
    """All share 37 words; pairs share 13 more with one word changed: the whole passage of 50 words is barely alike."""
    rng = random.Random(18)
    part = [f"c{i}" for i in range(37)]
    texts = []
    for i in range(400):
        own = [f"p{i // 2}_{j}" for j in range(13)]
        own[6] += "x" * (i % 2)
        texts.append(" ".join([f"r{rng.random()}" for _ in range(20)] + part + own + [f"s{rng.random()}" for _ in range(20)]))
    assert alike(texts[0].split()[20:70], texts[1].split()[20:70])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in substrings.repeated_passages(df).collect()}
    assert got == {(i, i ^ 1) for i in range(400)}


def test_passages_partly_inside_another(spark):
    """Many share 60 words; pairs share the last 44 of them and 6 more, which is too little of it to be alike to the others' words."""
    rng = random.Random(28)
    part = [f"c{i}" for i in range(60)]
    texts = []
    for i in range(120):
        own = [f"p{i // 2}_{j}" for j in range(6)]
        texts.append(" ".join([f"r{rng.random()}" for _ in range(20)] + part + own + [f"s{rng.random()}" for _ in range(20)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in substrings.repeated_passages(df).collect() if r.start <= 36 and r.stop >= 86}
    assert got == {(i, i ^ 1) for i in range(120)}


def test_passages_at_all_places(spark):
    """A text that holds a passage several times has a row for each place, also where the first one is a part only."""
    rng = random.Random(38)
    noise = lambda n: [f"r{rng.random()}" for _ in range(n)]
    licence = [f"c{i}" for i in range(70)]
    texts = [noise(10) + licence + noise(30) + licence + noise(20) + licence, noise(15) + licence + noise(5), noise(5) + licence[12:58] + noise(40) + licence + noise(9)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [(r.doc_id, r.start, r.stop) for r in substrings.repeated_passages(df).collect()]
    for doc, start, stop in ((0, 10, 80), (0, 110, 180), (0, 200, 270), (1, 15, 85), (2, 91, 161)):
        assert any(d == doc and start - 5 <= x <= start and stop <= y <= stop + 5 for d, x, y in got)


def test_windows_of_many_texts():
    """Texts that lie one after the other have the windows of each alone, and no run reaches into the next text."""
    rng = np.random.default_rng(6)
    lists = [words.mix(rng.integers(0, 2**60, n).astype(np.uint64)) for n in (80, 3, 0, 46, 45, 200, 47)]
    got = substrings.windows(np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])]), 46)
    want = set()
    for k, x in enumerate(lists):
        alone = substrings.windows(x, np.array([0, len(x)]), 46)
        want |= {(s, k, *r) for s, _, *r in zip(*(c.tolist() for c in alone), strict=True)}
        for band, (one, two) in enumerate(words.seeds(14, 333).reshape(7, 2)):
            least = [tuple(i + int(np.argmin(words.mix(x[i : i + 46] ^ seed))) for seed in (one, two)) for i in range(len(x) - 45)]
            assert band > 0 or {at for *_, at in zip(*(c.tolist() for c in alone), strict=True)} >= {p for p, _ in least}
    assert set(zip(*(c.tolist() for c in got), strict=True)) == want and len(got[0]) == len(want)


def test_hubs_are_those_of_spark(spark):
    rows = [(0, 0), (-5, 7), (2**62 + 11, 123456), (-(2**63), 2**31 - 1)]
    df = spark.createDataFrame(rows, "t long, p int").select(*(F.xxhash64(c, F.lit(k)) for c in "tp" for k in (0, 2)))
    t, p = (np.array(x) for x in zip(*rows, strict=True))
    made = [substrings._hashed(x, k, long) for x, long in ((t, True), (p, False)) for k in (0, 2)]
    assert [tuple(r) for r in df.collect()] == list(zip(*(m.tolist() for m in made), strict=True))


def test_passages_leave_small_tables(spark, monkeypatch):
    """Texts of ever the same passage: windows are written packed, not as rows, and few are compared with all others."""
    rng = random.Random(48)
    part = [f"c{i}" for i in range(60)]
    texts = [" ".join(w for _ in range(12) for w in [*part, *(f"r{rng.random()}" for _ in range(15))]) for _ in range(24)]
    written, keep = [], substrings.cut_lineage

    def cut(df):
        written.append(keep(df))
        return written[-1]

    monkeypatch.setattr(substrings, "cut_lineage", cut)
    monkeypatch.setattr(substrings, "drop_written", lambda session, df: None, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = substrings.repeated_passages(df).collect()
    for i, k in ((i, k) for i in range(24) for k in range(12)):
        assert any(r.doc_id == i and abs(r.start - 75 * k) <= 5 and abs(r.stop - 75 * k - 60) <= 5 for r in got)
    assert sum(t.count() for t in written) < 2 * sum(len(t.split()) for t in texts)


def test_alike_runs_equal_sets():
    rng = np.random.default_rng(7)
    for kinds in (3, 40, 1000):
        mine = rng.integers(0, kinds, 400).astype(np.uint64)
        other = np.where(rng.random(400) < 0.85, mine, rng.integers(0, kinds, 400).astype(np.uint64))
        starts = rng.integers(0, 380, 200)
        there = np.where(rng.random(200) < 0.5, starts, rng.integers(0, 380, 200))
        sets = [(set(mine[s : s + 20].tolist()), set(other[u : u + 20].tolist())) for s, u in zip(starts, there)]
        for percent in (50, 80):
            want = [100 * len(a & b) >= percent * len(a | b) for a, b in sets]
            assert substrings.alike(mine, other, starts, there, 20, percent).tolist() == want


def test_seeds_of_all_rows_are_read_at_once(monkeypatch):
    rows = np.zeros(7, substrings._TIGHT)
    rows["sig"], rows["low"], rows["width"], rows["place"] = np.arange(7), 10 * np.arange(7), 3, 2
    column = pa.array([[rows[:2].tobytes(), rows[2:3].tobytes()], [], [rows[3:].tobytes()]], pa.list_(pa.binary()))
    reads, real = [], np.frombuffer
    monkeypatch.setattr(substrings.np, "frombuffer", lambda *a: reads.append(1) or real(*a))
    got = list(substrings._seeds(column))
    assert [len(x) for x in got] == [3, 0, 4] and len(reads) == 1
    assert [tuple(x) for x in np.concatenate(got)] == [(i, 10 * i, 10 * i + 3, 10 * i + 2, 0) for i in range(7)]
