"""Archives written and read back, predicates and skipped payloads, and the query against its SQL on planted copies."""

import gzip
import hashlib
import os

import duckdb
import pytest

from check import compare
from flightloom.llm import warc as A

PAGES = "page_id long, url string, html string, digest string, best string, payload string, key string"


def rows():
    big, large = "<p>é</p>" * 200, "x" * 999
    made = [(i, f"http://a/{i}", big + str(i % 3)) for i in range(30)] + [(100 + i, None, big) for i in range(5)]
    made += [(200, "http://b/\r\nWARC-Type: x", large), (201, "u", large), (202, "u", large + "y"), (203, "u", large + "y")]
    made += [(300, "u", None), (301, "u", ""), (302, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (303, "u", "\x00\r\n\r\n" * 400)]
    made += [(None, "u", big), (400, "u", "same" * 400), (400, "u", "same" * 400), (None, "v", "lone" * 400), (None, "w", "lone" * 400)]
    return [(*r, "x", "x", "x", "x") for r in made]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(rows(), PAGES).repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT page_id, html FROM '{folder}/pages.parquet/*.parquet'")
    said = compare(spark, con, "op13", A.op13_warc, A.REGISTRY.oracles["op13_warc"], folder)
    assert said.startswith(f"ok {len(rows())} rows"), said


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert A.op13_warc(spark, str(tmp_path)).count() == 0
    os.mkdir(f"{tmp_path}/nothing")
    assert A.read_warc(spark, f"{tmp_path}/nothing").count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_filters_on_headers(spark, folder, compression):
    path = f"{folder}/archive-{compression}"
    A.write_warc(A.page_records(spark.read.parquet(f"{folder}/pages.parquet")), path, compression)
    every = A.read_warc(spark, path).collect()
    assert len(every) == len(rows())
    for r in every:
        assert r.headers["WARC-Record-ID"] == r.record_id and r.warc_date == "1970-01-01T00:00:00Z"
        if r.warc_type == "response":
            assert r.payload_digest == "sha1:" + hashlib.sha1(r.payload).hexdigest() and r.payload_length == len(r.payload)
        else:
            assert r.payload is None and r.headers["WARC-Profile"] == A.SAME_PAYLOAD
    plain = {f.name: f for f in A.read_warc(spark, path, "false").schema}
    assert "payload" not in plain and "payload_length" not in plain
    for condition in (
        "warc_type = 'revisit'", "warc_type IN ('response', 'x') AND content_length > 1500", "refers_to IS NULL", "NOT target_uri LIKE 'http%'",
        "record_id LIKE '%:2>' OR warc_type = 'revisit'", "target_uri LIKE '%a/1%' AND payload_length > 5", "target_uri <=> NULL", "warc_type <> 'revisit'",
    ):
        here = sorted(r.record_id for r in spark.createDataFrame(every, A.read_warc(spark, path).schema).where(condition).collect())
        assert sorted(r.record_id for r in A.read_warc(spark, path).where(condition).collect()) == here, condition


def test_predicates_reach_the_reader(spark, folder):
    path = f"{folder}/archive"
    A.write_warc(A.page_records(spark.read.parquet(f"{folder}/pages.parquet")), path, "none")
    reader = A.Warc({"path": path}).reader(A.read_warc(spark, path).schema)
    kind, other = A.ds.EqualTo(("warc_type",), "revisit"), A.ds.EqualTo(("payload",), b"x")
    assert list(reader.pushFilters([kind, other])) == [other]
    planned = [p for part in reader.partitions() for p in part.paths]
    for name in os.listdir(path):
        if name.endswith(".warc"):
            with open(f"{path}/{name}", "rb") as file:
                assert (f"WARC-Type: {'revisit' if f'{path}/{name}' in planned else 'response'}".encode()) in file.read()


def test_unwanted_blocks_are_not_read(tmp_path):
    path = f"{tmp_path}/one.warc"
    with open(path, "wb") as file:
        for kind in ("request", "response"):
            file.write(A.record_bytes({"WARC-Type": kind, "Content-Type": "text/plain"}, kind.encode() * 1000))

    class Counting(A.io.FileIO):
        got = 0

        def read(self, size=-1):
            data = super().read(size)
            Counting.got += len(data)
            return data

        def readline(self, size=-1):
            line = super().readline(size)
            Counting.got += len(line)
            return line

    with Counting(path) as file:
        found = [h["WARC-Type"] for h, _ in A.records(file, path)]
    assert found == ["request", "response"] and Counting.got < 1000


def test_foreign_and_damaged_files(spark, tmp_path):
    one = A.record_bytes({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x\r\n")
    odd = b"WARC/1.0\r\nwarc-type: resource\r\nX-Long: a\r\n  b\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n\r\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(one + odd)
    (tmp_path / "a" / "y.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(odd))
    found = A.read_warc(spark, f"{tmp_path}/a").where("warc_type = 'resource'").collect()
    assert [(bytes(r.payload), r.headers["X-Long"], r.target_uri) for r in found] == [(b"abc", "a b", None)] * 2
    assert A.read_warc(spark, f"{tmp_path}/a/x.warc").count() == 2
    (tmp_path / "a" / "z.warc").write_bytes(one[:-10])
    with pytest.raises(Exception, match="z.warc: the file ends in a block"):
        A.read_warc(spark, f"{tmp_path}/a").collect()


def test_files_of_lost_tasks_are_not_read(spark, folder):
    path = f"{folder}/lost"
    records = A.page_records(spark.read.parquet(f"{folder}/pages.parquet"))
    A.write_warc(records, path)
    with open(f"{path}/part-stray.warc", "wb") as file:
        file.write(A.record_bytes({"WARC-Type": "response"}, b"half of a reco")[:-20])
    assert A.read_warc(spark, path).count() == len(rows())
    A.write_warc(records, path)
    assert A.read_warc(spark, path).count() == 2 * len(rows())
