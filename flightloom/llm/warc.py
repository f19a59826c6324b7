"""WARC archives as a Spark data source: file partitions, header predicates, payloads read only where wanted (operator 13).

A folder holds ``.warc`` files and ``.warc.gz`` files with a gzip member for each record. The reader plans partitions from the files, leaves out files whose
record types a filter excludes, parses the headers of a record first and goes past the block of a record that a filter excludes. The writer
rolls over to a new file at a size and at each change of the record type; a list of the files of a finished job is
written at its end, so that files of tasks that were lost and done again are not read.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shared_dir
from ..workload.registry import Registry

REGISTRY = Registry()

#: Column of a record, and the header that holds it.
HEADERS = {
    "warc_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, headers map<string,string>"
HTTP = "application/http"
# Fixed value: the profile of a revisit whose payload equals an earlier one.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, BATCH_ROWS = 128 << 20, 64 << 20, 4 << 20, 4096


class DamagedArchive(ValueError):
    """A file that is no WARC archive, or ends in the middle of a record."""


# Records


def _line_safe(value: str) -> str:
    """A header's value on one line: control characters as percent codes."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record_bytes(headers: dict[str, str | None], block: bytes) -> bytes:
    """A record of version 1.1; headers without a value are left out."""
    lines = [f"{name}: {_line_safe(value)}" for name, value in headers.items() if value is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _names(lines: list[bytes]) -> dict[str, str]:
    """Headers by name; a line that begins with white space goes on with the last one."""
    found: dict[str, str] = {}
    last = None
    for line in lines:
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last is not None:
            found[last] += " " + text.strip()
        elif ":" in text:
            last, value = text.split(":", 1)
            last = last.strip()
            found[last] = value.strip()
    return found


def _head_lines(file: io.BufferedIOBase, where: str) -> list[bytes]:
    lines = []
    while (line := file.readline()).strip(b"\r\n"):
        lines.append(line)
    if not line:
        raise DamagedArchive(f"{where}: the file ends in a header")
    return lines


class Block:
    """The block of the record that was read last; nothing of it is read unless asked for."""

    def __init__(self, file: io.BufferedIOBase, length: int, where: str) -> None:
        self.file, self.left, self.where = file, length, where

    def read(self, most: int | None = None) -> bytes:
        size = self.left if most is None else min(most, self.left)
        data = self.file.read(size)
        if len(data) < size:
            raise DamagedArchive(f"{self.where}: the file ends in a block")
        self.left -= size
        return data

    def skip(self) -> None:
        if self.left and self.file.seekable():
            self.file.seek(self.left, io.SEEK_CUR)
            self.left = 0
        while self.left:
            self.read(1 << 20)

    def http_length(self) -> int | None:
        """Reads the head of an HTTP response; the length that it states. Only the payload is left then."""
        stated = None
        while self.left:
            line = self.file.readline(self.left)
            self.left -= len(line)
            if not line.strip(b"\r\n"):
                break
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                stated = int(value)
        return stated


def records(file: io.BufferedIOBase, where: str) -> Iterator[tuple[dict[str, str], Block]]:
    """Headers and unread block of each record; what the caller leaves of a block is gone past."""
    while True:
        line = file.readline()
        while line and not line.strip(b"\r\n"):
            line = file.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise DamagedArchive(f"{where}: no record begins with {line[:40]!r}")
        headers = _names(_head_lines(file, where))
        lower = {name.lower(): value for name, value in headers.items()}
        if not lower.get("content-length", "").isdigit():
            raise DamagedArchive(f"{where}: a record without a length")
        block = Block(file, int(lower["content-length"]), where)
        yield headers, block
        block.skip()


# Filters


def _checks() -> dict[type, Callable]:
    return {
        ds.EqualTo: lambda v, f: v == f.value,
        ds.EqualNullSafe: lambda v, f: v == f.value,
        ds.GreaterThan: lambda v, f: v > f.value,
        ds.GreaterThanOrEqual: lambda v, f: v >= f.value,
        ds.LessThan: lambda v, f: v < f.value,
        ds.LessThanOrEqual: lambda v, f: v <= f.value,
        ds.In: lambda v, f: v in f.value,
        ds.StringStartsWith: lambda v, f: v.startswith(f.value),
        ds.StringEndsWith: lambda v, f: v.endswith(f.value),
        ds.StringContains: lambda v, f: f.value in v,
    }


CHECKS = _checks()


def supported(f: ds.Filter) -> bool:
    """Filters on one header column, and their negations."""
    if isinstance(f, ds.Not):
        return supported(f.child)
    known = type(f) in CHECKS or isinstance(f, ds.IsNull | ds.IsNotNull)
    return known and len(f.attribute) == 1 and (f.attribute[0] in HEADERS or f.attribute[0] == "content_length")


def verdict(f: ds.Filter, value) -> bool | None:
    """SQL's answer of a filter for a value: a comparison with NULL is unknown."""
    if isinstance(f, ds.Not):
        inner = verdict(f.child, value)
        return None if inner is None else not inner
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return (value is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    return None if value is None else CHECKS[type(f)](value, f)


def _column(f: ds.Filter) -> str:
    return _column(f.child) if isinstance(f, ds.Not) else f.attribute[0]


# Reading


@dataclass
class Files(ds.InputPartition):
    """Some whole files for one task."""

    paths: list[str]


def _place(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _opened(store: arrow_fs.FileSystem, path: str) -> io.BufferedIOBase:
    file = store.open_input_file(path)
    packed = file.read(2) == b"\x1f\x8b"
    file.seek(0)
    return io.BufferedReader(gzip.GzipFile(fileobj=file)) if packed else io.BufferedReader(file, 1 << 16)


class WarcReader(ds.DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.schema, self.path = schema, options["path"]
        self.most = int(options.get("partition_bytes", PARTITION_BYTES))
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if supported(f):
                self.filters.append(f)
            else:
                yield f

    def _listed(self) -> list[tuple[str, int, list[str] | None]]:
        """Path, size and record types of each file: from the lists of finished jobs, or else of the folder."""
        store, root = _place(self.path)
        info = store.get_file_info(root)
        if info.is_file:
            return [(root, info.size, None)]
        found = store.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
        lists = [f.path for f in found if f.base_name.startswith("_list-")]
        if lists:
            out = []
            for path in lists:
                with store.open_input_stream(path) as file:
                    out += [(f"{root}/{name}", size, [kind]) for name, size, kind in json.loads(file.read())]
            return out
        return [(f.path, f.size, None) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]

    def partitions(self):
        """Whole files, small ones together up to ``partition_bytes``; none whose record types are all excluded."""
        on_type = [f for f in self.filters if _column(f) == "warc_type"]
        planned: list[Files] = []
        room = 0
        for path, size, kinds in sorted(self._listed(), key=lambda f: f[0]):
            if kinds is not None and not any(all(verdict(f, k) for f in on_type) for k in kinds):
                continue
            if not planned or size > room:
                planned.append(Files([]))
                room = self.most
            planned[-1].paths.append(path)
            room -= size
        return planned or [Files([])]

    def read(self, partition):
        names = [f.name for f in self.schema.fields]
        held, size = [], 0
        schema = to_arrow_schema(self.schema)
        store, _ = _place(self.path)
        for path in partition.paths:
            with _opened(store, path) as file:
                for headers, block in records(file, path):
                    lower = {name.lower(): value for name, value in headers.items()}
                    row = {c: lower.get(h.lower()) for c, h in HEADERS.items()}
                    row["content_length"] = block.left
                    if not all(verdict(f, row[_column(f)]) for f in self.filters):
                        continue
                    row["headers"] = list(headers.items())
                    if "payload_length" in names or "payload" in names:
                        http = (row["content_type"] or "").startswith(HTTP)
                        stated = block.http_length() if http else None
                        revisit = row["warc_type"] == "revisit"
                        row["payload_length"] = stated if revisit else block.left
                        row["payload"] = block.read() if "payload" in names and not revisit else None
                        size += len(row["payload"] or b"")
                    held.append([row[c] for c in names])
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield _batch(held, schema)
                        held, size = [], 0
        if held:
            yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# Writing


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, int, str]]


class WarcWriter(ds.DataSourceArrowWriter):
    """Writes rows of ``warc_type``, ``record_id``, ``target_uri``, ``payload``, ``payload_length``, ``payload_digest``, ``refers_to``."""

    def __init__(self, options) -> None:
        self.path = options["path"]
        self.packed = options.get("compression", "gzip") == "gzip"
        self.most = int(options.get("file_bytes", FILE_BYTES))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def _record(self, row: dict) -> bytes:
        revisit = row["warc_type"] == "revisit"
        headers = {h: row.get(c) for c, h in HEADERS.items()}
        headers |= {"WARC-Date": self.date, "Content-Type": f"{HTTP}; msgtype=response", "WARC-Profile": SAME_PAYLOAD if revisit else None}
        block = http_head(row["payload_length"]) + (b"" if revisit else row["payload"])
        record = record_bytes(headers, block)
        return gzip.compress(record, compresslevel=1, mtime=0) if self.packed else record

    def write(self, iterator):
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        files: list[tuple[str, int, str]] = []
        out, name, size, kind = None, "", 0, None
        for batch in iterator:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                if out is None or size >= self.most or row["warc_type"] != kind:
                    if out is not None:
                        out.close()
                        files.append((name, size, kind))
                    name, size, kind = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed, 0, row["warc_type"]
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                size += out.write(self._record(row))
        if out is not None:
            out.close()
            files.append((name, size, kind))
        return Written(files)

    def commit(self, messages):
        store, root = _place(self.path)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(f"{root}/_list-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        store, root = _place(self.path)
        for name, _, _ in (f for m in messages if m is not None for f in m.files):
            store.delete_file(f"{root}/{name}")


class Warc(ds.DataSource):
    """``spark.read.format("warc")``; option ``payload``: ``true`` (default), ``length`` (only its length), ``false``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        more = {"true": ", payload_length long, payload binary", "length": ", payload_length long", "false": ""}
        return SCHEMA + more[self.options.get("payload", "true")]

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: str = "true") -> DataFrame:
    """The records of a file or folder. Filters on header columns are applied to the headers, before the block is read.

    A record without a header has NULL there; an empty folder has no records; a damaged file is an error that names it. A revisit has no payload; its
    ``payload_length`` is what the HTTP head in its block states.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("payload", payload).load(path)


def write_warc(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """Add archives of the rows (columns as in :class:`WarcWriter`) to a folder; rows of a task are sorted by type, for whole files of one type."""
    rows.sparkSession.dataSource.register(Warc)
    rows.sortWithinPartitions("warc_type").write.format("warc").option("compression", compression).mode("append").save(path)


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> DataFrame:
    """A record for each page: of pages with equal payloads of ``least`` bytes or more, the largest key's is a response and the others revisit it.

    Payloads are equal when length and SHA-256 are. A NULL page is an empty payload. A row that repeats the key of the response is a response as well; a NULL
    key is never preferred, and pages with equal payloads and no key at all are all responses. Other columns are not read.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), F.encode(F.coalesce(html, F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"payload_length": F.length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    large = rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.max("key").alias("best"), F.count("*").alias("pages"))
    rows = rows.join(large.where("pages > 1").select("digest", "best"), "digest", "left")
    revisit = F.col("best").isNotNull() & ~F.col("key").eqNullSafe(F.col("best"))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        page_name(F.col("key")).alias("record_id"),
        "target_uri",
        F.when(revisit, None).otherwise(F.col("payload")).alias("payload"),
        "payload_length",
        F.concat(F.lit("sha1:"), F.sha1("payload")).alias("payload_digest"),
        F.when(revisit, page_name(F.col("best"))).alias("refers_to"),
    )


def page_name(key: Column) -> Column:
    """The record id of a page, a URN; without a key it ends after the colon."""
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def page_of(name: str) -> Column:
    return F.regexp_extract(name, "^<urn:x-page:(.+)>$", 1)


@REGISTRY.add(
    "op13_warc",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest, coalesce(html, '') AS html FROM pages
    ), b AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS best FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN best IS NULL OR page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
    FROM b
    """,
)
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(page_records(pages), path)
    kind = pages.schema["page_id"].dataType

    def number(name: str) -> Column:
        found = page_of(name)
        return F.when(found != "", found).cast(kind)

    whole = read_warc(spark, path).where("warc_type = 'response'").select(
        number("record_id").alias("page_id"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast(kind).alias("refers_to"),
    )
    again = read_warc(spark, path, "length").where("warc_type = 'revisit'").select(
        number("record_id"), "payload_length", F.substring("payload_digest", 6, 40), "warc_type", number("refers_to")
    )
    return whole.union(again)
