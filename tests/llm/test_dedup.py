"""Exact and near duplicates against brute force."""

import hashlib
import re

import numpy as np
import pytest

from flightloom.llm import components, exact_dedup, near_dedup, words
from tests.conftest import rows


def brute_exact(corpus):
    out = []
    for key, text, *_ in corpus:
        same = [k for k, t, *_ in corpus if (t or "") == (text or "")]
        keep = max((k for k in same if k is not None), default=None)
        out.append((key, keep, len(same), key == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(docs, wide_docs, no_docs, corpus):
    assert rows(exact_dedup.exact_groups(docs, salts=3)) == brute_exact(corpus)
    assert rows(exact_dedup.exact_groups(wide_docs)) == brute_exact(corpus)
    assert rows(exact_dedup.exact_groups(no_docs)) == []


def test_exact_drop(docs, wide_docs, no_docs, corpus):
    want = sorted({r[0] for r in corpus if r[0] is not None and r[0] == max(k for k, t, *_ in corpus if k is not None and (t or "") == (r[1] or ""))})
    kept = exact_dedup.drop_exact(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert exact_dedup.drop_exact(wide_docs).columns == wide_docs.columns
    assert exact_dedup.drop_exact(no_docs).count() == 0


def test_equal_digests_of_other_texts_stay_apart(spark, monkeypatch):
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(exact_dedup.F.lit("one digest for all"), n))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    got = rows(exact_dedup.exact_groups(df).select("doc_id", "keep_id", "group_size"))
    assert got == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def shingle_set(text, size):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute_near(corpus, size, percent):
    sets = {k: shingle_set(t, size) for k, t, *_ in corpus if k is not None}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_groups(docs, wide_docs, corpus, size, percent):
    want = brute_near(corpus, size, percent)
    for df in (docs, wide_docs):
        got = near_dedup.near_groups(df, size=size, percent=percent).collect()
        assert len(got) == len(corpus)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
        assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


def test_near_without_rows(no_docs, docs):
    assert near_dedup.near_groups(no_docs).count() == 0
    assert near_dedup.drop_near(docs).columns == docs.columns


def test_links_that_hubs_miss(spark):
    """A chain: each text is alike to the next, the ends are not alike to the middle's other neighbours."""
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base[: 120 - 4 * i] + [f"u{j}" for j in range(4 * i)]) for i in range(12)]
    corpus = [(i, t) for i, t in enumerate(texts)]
    got = near_dedup.near_groups(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_near(corpus, 3, 85)


def test_super_min_hash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        items = words.mix(rng.integers(0, 2**62, 60).astype(np.uint64))
        a, b = near_dedup.super_min_hash(items[:45]), near_dedup.super_min_hash(items[15:])
        errors.append((a == b).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.03
    assert np.std(errors) < 0.044  # below plain min-hash's sqrt(0.25 / 128)


def test_signature_levels_are_a_permutation():
    one = near_dedup.super_min_hash(np.array([99], np.uint64))
    assert sorted(one.astype(int).tolist()) == list(range(near_dedup.SLOTS))


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 9), (10, 11), (12, 11), (20, 20)] + [(100, 100 + i) for i in range(1, 60)]
    got = dict(rows(components.components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**dict.fromkeys((3, 4, 5, 9), 3), **dict.fromkeys((10, 11, 12), 10), **dict.fromkeys(range(100, 160), 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_word_hashes_over_blocks(monkeypatch):
    text = " ".join(f"word{i % 50}" for i in range(3000)).encode()
    buf, offsets = np.frombuffer(text, np.uint8), np.array([0, 7, 7, len(text)])
    whole = words.word_hashes(buf, *words.spans(buf, offsets)[:2], words.letters(True))
    monkeypatch.setattr(words, "STEP", 64)
    assert (words.word_hashes(buf, *words.spans(buf, offsets)[:2], words.letters(True)) == whole).all()


def test_words_of_one_build_have_hashes_of_their_own(spark):
    """Words of two letters that polynomial hashes modulo a power of two can't tell apart."""
    plain = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = plain.translate(str.maketrans("ab", "ba"))
    corpus = [(1, plain), (2, other), (3, f"x {plain} y z"), (4, f"x {other} y z"), (5, plain.upper()), (6, "a" * 200), (7, "a" * 264)]
    got = near_dedup.near_groups(spark.createDataFrame(corpus, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}


def test_shared_shingles_are_those_of_the_words():
    rng = np.random.default_rng(4)
    for _ in range(400):
        texts = [" ".join(rng.choice(["a", "B", "b", "é", "cc"], rng.integers(0, 9))) for _ in range(2)]
        size = int(rng.integers(1, 5))
        sets = []
        for text in texts:
            w = text.replace("B", "b").split()
            sets.append({tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set())
        want = len(sets[0]), len(sets[1]), len(sets[0] & sets[1])
        assert words.shared_shingles(tuple(t.encode() for t in texts), size) == want, texts
