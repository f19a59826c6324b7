"""Registered queries against their SQL, and the pipeline's stages, on the smallest test tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, connect
from flightloom.llm import near_dedup, pii, toxicity
from flightloom.llm.queries import llm_queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_query_equals_sql(spark, name):
    said = compare(spark, connect(str(DATA)), name, queries()[name], oracle_sql().get(name), str(DATA))
    assert not said.startswith("FAIL"), said


def test_numbers_of_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 14))
    assert "pipeline" in queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    tables = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(DATA))
        if n < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        tables.append(docs.collect())
    clean, exact, near, masked, packed = tables
    start = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scores = toxicity.score(start, toxicity.train(start, labels.where(~toxicity.held_out()))).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in scores if r.score < 0.3}
    largest = {}
    for r in clean:
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", -1))
    assert {r.doc_id for r in exact} == set(largest.values())
    kept = near_dedup.near_groups(spark.createDataFrame(exact, start.schema), size=5, percent=80).where("kept").collect()
    assert {r.doc_id for r in near} == {r.doc_id for r in kept}
    assert {r.doc_id for r in masked} == {r.doc_id for r in near}
    for r in masked:
        plain = before[r.doc_id].text
        assert r.n_chars == len(r.text) and (r.text == plain or pii.examine(plain)[1])
        for _, a, b in pii.base_spans(plain):
            assert plain[a:b] not in r.text or plain.count(plain[a:b]) > 1 or len(plain[a:b]) < 8
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: r.doc_tokens for r in packed} and set(lengths) == {r.doc_id for r in masked}
