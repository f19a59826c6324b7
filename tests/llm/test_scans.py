"""Secrets, personal data and toxicity."""

import random
import re
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from flightloom.llm import pii, secrets, toxicity
from tests.conftest import rows

ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def brute_secrets(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)]


def secret_texts():
    rng = random.Random(5)
    parts = ["token", "Secret", ": ", "=", '"', "'", " ", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "a", "é🙂", "\n", "api_key", "abcdefgh"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(300)]
    return [*texts, "token=abcdefgh1 " * 700, "", None, "Tk9aQ" * 6 + "7", "x token: short", "token: secret: abcdefghij"]


def scanned(spark, texts, owners):
    df = spark.createDataFrame([(i, t, o, "clash") for i, (t, o) in enumerate(zip(texts, owners, strict=True))], "doc_id long, text string, source string, hash string")
    return secrets.scan(df, F.col("source"), F.col("source"))


def test_base_secrets(spark):
    texts = secret_texts()
    got = scanned(spark, texts, ["o"] * len(texts)).select("doc_id", secrets.joined(F.col("base")).alias("base")).collect()
    assert {r.doc_id: r.base for r in got} == {i: ",".join(brute_secrets(t)) for i, t in enumerate(texts)}


def test_owners_tell_examples_from_live_values(spark):
    live, copied = "Zk3vQ9xLm2Pw8RtY5nBc7HdJ", "Ab1cD2eF3gH4iJ5kL6mN7oP8"
    texts = [f"see {copied} here" for _ in range(8)] + [f"own {live}", f"again {live}", "an Example9Example9Example9Ab"]
    owners = [f"o{i}" for i in range(8)] + ["me", "me", "me"]
    got = {r.doc_id: r for r in scanned(spark, texts, owners).collect()}
    assert all(got[i].n_copied == 1 and not got[i].added for i in range(8))
    assert [len(got[i].added) for i in (8, 9, 10)] == [1, 1, 0]
    assert got[8].added[0].start == 4 and got[8].n_live == 1


def test_secrets_without_rows_and_plan(spark, no_docs):
    found = secrets.scan(no_docs, F.col("source"), F.col("source"))
    assert found.count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def brute_pii(text):
    def luhn(n):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(n))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_personal_data():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("ab@@..1234+- (é٣") for _ in range(rng.randrange(40)))
        assert sorted(pii.base_spans(text)) == brute_pii(text)
    assert pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]


def pii_texts():
    rng = random.Random(9)
    texts = [f"write to mail{i}@host{i}.example.com now" for i in range(40)]
    texts += [f"contact: mail{i} [at] host{i} [dot] com please" for i in range(12)]
    texts += [f"serial 10{rng.randrange(10**14):014d}" for _ in range(30)]
    texts += [f"call +1 (555) 010-{i:04d} or 10.0.0.{i}" for i in range(30)]
    return [*texts, "", None, "plain words " * 3000]


def test_weak_supervision_adds_spelt_out_addresses(spark):
    texts = pii_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, doc string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert all(got[i].base == pii.said(pii.base_spans(t or "")) for i, t in enumerate(texts))
    assert all(got[i].added.startswith("email:9:") for i in range(40, 52))
    assert not any(got[i].added for i in range(52, 82))
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "write to [EMAIL] now" and clean[40] == "contact: [EMAIL] please"
    assert clean[82] == "call [PHONE] or [IP]" and clean[len(texts) - 2] is None
    assert clean[52] == texts[52]


def test_reliabilities_tell_good_voters_from_random_ones():
    rng = np.random.default_rng(0)
    true = rng.random(20000) < 0.4
    cast = np.stack([np.where(rng.random(20000) < good, np.where(true, 2, 0), np.where(true, 0, 2)) for good in (0.95, 0.9, 0.85, 0.5, 0.9)], axis=1)
    codes, counts = np.unique((cast * 3 ** np.arange(5)).sum(axis=1), return_counts=True)
    likely, _ = pii.reliabilities(codes, counts.astype(float))
    assert np.abs(likely[:, 1, 2] - [0.95, 0.9, 0.85, 0.5, 0.9]).max() < 0.03


def test_personal_data_without_rows(no_docs, docs, corpus, wide_docs):
    assert pii.find(no_docs).count() == 0
    assert pii.find(wide_docs).count() == len(corpus)
    assert pii.redact(docs).columns == docs.columns


def toxic_corpus():
    rng = random.Random(11)
    out = []
    for i in range(600):
        lines = [" ".join(f"v{rng.randrange(300)}" for _ in range(8)) for _ in range(rng.randrange(1, 8))]
        bad = rng.random() < 0.25
        if bad:
            lines.insert(rng.randrange(len(lines) + 1), f"you {rng.choice(['nasty', 'vilest', 'rotten'])} v{rng.randrange(300)}")
        out.append((i, ". ".join(lines), int(bad)))
    return out


def test_toxicity_learns_sentences_from_documents(spark):
    data = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, ""), (None, "v1 v2")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    unseen = [(got[i].score, y, got[i].offending, t) for i, t, y in data if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(y) for s, y, _, _ in unseen]) > 0.95
    for _, _, where, text in (u for u in unseen if u[1] and u[2]):
        cut = [text[int(a) : int(b)] for a, b in (x.split(":") for x in where.split(","))]
        assert any(re.search("nasty|vilest|rotten", c) for c in cut)
    assert got[900].score == got[901].score == 0.0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {900, 901, None} <= {r.doc_id for r in kept.collect()}


def test_toxicity_without_rows(spark, no_docs, wide_docs, corpus):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(no_docs, toxicity.train(no_docs, labels)).count() == 0
    assert toxicity.score(wide_docs, toxicity.train(wide_docs, labels)).count() == len(corpus)


def test_noisy_or():
    logits = np.log(np.array([0.2, 0.5, 0.1]) / np.array([0.8, 0.5, 0.9]))
    assert np.allclose(toxicity.noisy_or(logits, np.array([0, 2, 2, 3])), [0.6, 0.0, 0.1])


def test_digest_of_base(spark, tmp_path):
    spark.createDataFrame([(1, "mail a@b.cc and 1.2.3.4", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = pii.op7_pii(spark, str(tmp_path)).first()
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 0, 0)
    assert got.base_sha256 == sha256(b"email:5:11,ip:16:23").hexdigest()
    assert rows(secrets.op2_secrets(spark, str(tmp_path)).select("n_assign", "spans")) == [(0, "")]


def test_one_long_document_does_not_use_up_the_sample(spark, monkeypatch):
    data = toxic_corpus()
    monkeypatch.setattr(toxicity, "MAX_WORDS", sum(len(t.split()) for _, t, _ in data) + 5000)
    first = spark.range(10_000, 20_000).orderBy(F.xxhash64("id", F.lit(11))).first().id
    for n in (100_000, 4_000):  # one that doesn't fit, and one that nearly does
        docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(first, "word " * n)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(first, 0)], "doc_id long, toxic int")
        model = toxicity.train(docs, labels)
        got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
        assert len(model.keys) and np.mean([(got[i] >= 0.3) == bool(y) for i, _, y in data]) > 0.95


def test_toxicity_learns_from_more_than_eight_thousand_documents(spark):
    rng = random.Random(5)
    order = [r.id for r in spark.range(12_000).orderBy(F.xxhash64("id", F.lit(11)), "id").collect()]
    bad = set(order[-400:])
    data = [(i, " ".join(f"v{rng.randrange(200)}" for _ in range(6)) + (" vilest" if i in bad else "")) for i in order]
    model = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([(i, int(i in bad)) for i in order], "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame([(1, "v1 v2 vilest v3"), (2, "v1 v2 v3")], "doc_id long, text string"), model)
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[1] >= 0.3 > scores[2]


def test_spelt_addresses_do_not_depend_on_other_words():
    for address in ("jane at example.com", "jane @ example.com", "jane (at) example dot com"):
        for rest in ("", " and a dotted line"):
            assert (0, 5, 5 + len(address)) in pii.proposals(f"ask: {address}{rest and ';' + rest}")
