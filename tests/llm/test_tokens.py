"""Encoding, packing and language-model scores against libraries and brute force."""

import collections
import functools
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flightloom.llm import bpe, lm_scoring, packing
from flightloom.session import shared_dir

BYTE_BPE, WORD_BPE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(4)
    letters = "ab Zé'sTl\n\t 　​🙂👩🏽́中文٣²½<|endoftext|>123 .,;\x00\x1c\x85ΑΣς"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", "<|end", " ", "'s", "é"]) for _ in range(9)) for _ in range(200)]
    return [*texts, "a" * 4000, "  " * 3000, "", "🙂" * 900, "ab" * 9000, "It's we'll they'd I'M"]


def test_byte_pairs_equal_the_library():
    own, library = bpe.load(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(text), "<u4")
        assert got.tolist() == ids, repr(text)
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False) == text


def test_decoding_of_cut_characters():
    own, library = bpe.load(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    ids = library.encode("🙂é", add_special_tokens=False).ids
    assert own.decode(np.array(ids[:1])) == library.decode(ids[:1], skip_special_tokens=False)


def test_encode_and_decode_tables(wide_docs, no_docs, corpus):
    back = bpe.decode(bpe.encode(wide_docs, BYTE_BPE), BYTE_BPE).collect()
    assert sorted((r.doc_id, r.decoded) for r in back if r.doc_id is not None) == sorted((k, t or "") for k, t, *_ in corpus if k is not None)
    assert all(r.n_tokens * 4 == len(r.ids) for r in back) and len(back) == len(corpus)
    assert bpe.encode(no_docs, BYTE_BPE).count() == 0


def test_forgotten_words_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    own, library = packing.WordIds(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    for text in odd_texts():
        assert np.frombuffer(own([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing(wide_docs, corpus):
    library = Tokenizer.from_file(WORD_BPE)
    got = packing.pack(wide_docs, WORD_BPE, size=64).collect()
    whole = collections.defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        whole[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for key, text, *_ in corpus:
        if key is not None and [k for k, *_ in corpus].count(key) == 1:
            assert sum((ids for _, ids in sorted(whole[key])), []) == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    assert sum(r.length for r in got) / (64 * len(places)) > 0.85


def test_packing_without_rows(no_docs):
    assert packing.pack(no_docs, WORD_BPE).count() == 0


def test_windows_of_ranks(docs, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 7)
    got = packing.assign(packing.pieces(docs, WORD_BPE, size=64), size=64).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


@pytest.mark.parametrize("seed", range(4))
def test_patterns_against_all_packings(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(2, 9), 3, replace=False))
    demand = rng.integers(3, 9, 3)
    fillings = [c for c in itertools.product(range(6), repeat=3) if 0 < np.dot(c, sizes) <= 10]

    @functools.cache
    def least(left):
        if not any(left):
            return 0
        return 1 + min(least(tuple(max(0, a - b) for a, b in zip(left, c, strict=True))) for c in fillings if np.dot(np.minimum(c, left), sizes))

    used = packing.patterns(demand, sizes, 10)
    assert (sum(column * times for column, times in used) == demand).all()
    assert all(column @ sizes <= 10 for column, _ in used)
    assert sum(times for _, times in used) <= least(tuple(map(int, demand))) + 1


def test_patterns_fill_nearly_all_room():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(np.minimum(np.ceil(rng.lognormal(3, 1, 20000)).astype(int), 200), return_counts=True)
    used = packing.patterns(demand, sizes, 256)
    assert (sum(column * times for column, times in used) == demand).all()
    assert sum(times for _, times in used) <= 1.002 * (demand @ sizes) / 256 + 1


def test_knapsack_against_all_fillings():
    sizes, values = np.array([2, 3, 5]), np.array([1.0, 1.7, 2.9])
    for room in range(2, 20):
        best = max(
            a * 1.0 + b * 1.7 + c * 2.9 for a in range(11) for b in range(8) for c in range(5) if 2 * a + 3 * b + 5 * c <= room
        )
        value, counts = packing.knapsack(values, sizes, room)
        assert math.isclose(value, best) and math.isclose(counts @ values, best) and counts @ sizes <= room


def brute_losses(corpus, target, size):
    words = [(k, re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))) for k, t, *_ in corpus]
    counts = collections.Counter(w for _, ws in words for w in ws)
    top = {w for w, _ in counts.most_common(size)}

    def events(ws):
        named = [w if w in top else None for w in ws]
        return list(zip(["begin", *named], [*named, "end"], strict=True))

    def model(rows):
        pairs = collections.Counter(e for ws in rows for e in events(ws))
        first, second = collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            first[a] += n
            second[b] += n
        total = sum(second.values())

        def loss(a, b):
            base = (second[b] + lm_scoring.ADDED) / (total + lm_scoring.ADDED * (len(top) + 2))
            own = pairs[a, b] / first[a] if first[a] else base
            return -math.log(lm_scoring.BIGRAM_WEIGHT * own + (1 - lm_scoring.BIGRAM_WEIGHT) * base)

        return loss

    wanted, all_of = model([ws for k, ws in words if k in target]), model([ws for _, ws in words])
    return sorted((sum(wanted(*e) for e in events(ws)) / (len(ws) + 1), sum(all_of(*e) for e in events(ws)) / (len(ws) + 1)) for _, ws in words)


def test_losses_equal_brute_force(spark, wide_docs, corpus):
    target = spark.createDataFrame([(k,) for k in (1, 3, 5, 7, 7, None, 5000)], "doc_id long")
    counts = collections.Counter(w for _, t, *_ in corpus for w in re.findall("[^\x20\x09-\x0d]+", (t or "").lower()))
    times = sorted(counts.values(), reverse=True)
    size = next(n for n in range(20, 400) if times[n - 1] > times[n])
    got = lm_scoring.cross_entropy_difference(wide_docs, target, size=size, chunk=900).collect()
    assert np.allclose(sorted((r.target_loss, r.background_loss) for r in got), brute_losses(corpus, {1, 3, 5, 7}, size))
    assert all(math.isclose(r.score, r.target_loss - r.background_loss, abs_tol=1e-12) for r in got)


def test_losses_without_rows(spark, no_docs, docs, corpus):
    none = spark.createDataFrame([], "doc_id long")
    assert lm_scoring.cross_entropy_difference(no_docs, none).count() == 0
    assert lm_scoring.cross_entropy_difference(docs, none).count() == len(corpus)


def test_rare_words_count(spark):
    """Documents that differ only in words outside the most frequent 4,096 have their own losses."""
    texts = [" ".join(f"w{i}" for i in range(4200))] * 2 + ["rare words here", "other terms there"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    assert got[2] < got[3] - 1
    rows = [(i, t) for i, t in enumerate(texts)]
    got = lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(2,)], "doc_id long")).collect()
    assert np.allclose(sorted((r.target_loss, r.background_loss) for r in got), brute_losses(rows, {2}, None))


def test_packed_numbers():
    for values in ([0], [1, 1, 255], [256, 0, 7], [2**64 - 1, 5], list(range(70_000))):
        assert lm_scoring.unpacked(lm_scoring.packed(np.array(values, np.uint64))).tolist() == values


def test_bigrams_take_less_disk_than_twice_the_texts(spark):
    rng = random.Random(3)
    texts = [" ".join(f"{rng.randrange(10**7):07}" for _ in range(500)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    lm_scoring.cross_entropy_difference(df, spark.createDataFrame([(1,), (2,)], "doc_id long")).count()
    made = [f for d in set(folder.iterdir()) - before for f in d.rglob("*.parquet")]
    assert sum(f.stat().st_size for f in made) < 2 * sum(map(len, texts))
