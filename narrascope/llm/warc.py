"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans one partition for each archive file (or group of small ones).  It parses a
record's headers first; predicates on ``record_type``, ``target_uri``, ``record_id``, ``refers_to`` and ``page_id`` that Spark
pushes down are decided on them, and the payload of a record that they reject, or that nothing asks for (option
``payload`` = false), is skipped without being decoded or copied.  Every archive member is compressed on its own.

The writer is a data source too.  Each task writes archives of a bounded size under names of its own attempt; the commit
lists the files that count in a manifest, so files of lost or repeated attempts are never read.  A folder without a
manifest, as a crawl leaves it, is read by listing its ``.warc`` and ``.warc.gz`` files; a single file can be read too.

Files are opened by pyarrow's file systems, by the scheme of their path.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from narrascope.llm.rows import BATCH_BYTES, bound_batches
from narrascope.llm.skew import hot_join
from narrascope.session import Scratch

SCHEMA = "page_id long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
MANIFEST = "manifest.json"
FILE_BYTES = 64 << 20
#: Headers that hold a column, for records and for predicates.
_HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest", "page_id": "X-Page-ID", "payload_bytes": "X-Payload-Length",
}
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_WITH_PAYLOAD = ("response", "resource", "conversion")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    """The record's URN, made of its page."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value) -> str:
    """A header value without line breaks."""
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; ``refers_to`` names the page of the response that a revisit repeats."""
    if refers_to is None:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        more = ""
    else:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = f"WARC-Profile: {_REVISIT}\r\nWARC-Refers-To: {record_id(refers_to)}\r\nX-Refers-To-Page: {refers_to}\r\n"
    page = "" if page_id is None else f"X-Page-ID: {page_id}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {'response' if refers_to is None else 'revisit'}\r\nWARC-Record-ID: {record_id(page_id)}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Target-URI: {_clean(url)}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\n"
        f"{page}X-Payload-Length: {len(payload)}\r\n{more}Content-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


class _Members:
    """A file of gzip members or plain records as a stream that can skip."""

    def __init__(self, source, size: int = 1 << 20):
        self.source, self.size, self.buffer, self.at = source, size, b"", 0
        first = source.read(2)
        self.raw = first
        self.packed = first == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def _more(self) -> bool:
        chunk = self.raw or self.source.read(self.size)
        self.raw = b""
        if self.packed:
            out = b""
            while not out:
                if not chunk:
                    chunk = self.source.read(self.size)
                    if not chunk:
                        return False
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
                out = self.inflate.decompress(chunk)
                chunk = self.inflate.unused_data if self.inflate.eof else b""
            self.raw = chunk
            chunk = out
        if not chunk:
            return False
        self.buffer, self.at = self.buffer[self.at :] + chunk, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = self.at
        while (end := self.buffer.find(mark, seen)) < 0:
            left = len(self.buffer) - self.at
            if not self._more():
                return None
            seen = max(0, left - len(mark) + 1)
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at == len(self.buffer) and not self._more():
                raise EOFError("a record ends early")
            parts.append(self.buffer[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def skip(self, n: int) -> None:
        while len(self.buffer) - self.at < n:
            n -= len(self.buffer) - self.at
            self.at = len(self.buffer)
            if not self._more():
                raise EOFError("a record ends early")
        self.at += n


def read_records(source, predicates: list[tuple[str, set[str]]], payload: bool, verify: bool) -> Iterator[tuple]:
    """Rows of the records of an open archive whose headers fit all predicates (header, values)."""
    stream = _Members(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        get, kind = headers.get, headers.get("warc-type", "")
        length = int(headers["content-length"])
        if any(get(name.lower()) not in values for name, values in predicates):
            stream.skip(length + 4)
            continue
        digest = get("warc-payload-digest", "").removeprefix("sha1:") or None
        body = None
        if payload and kind in _WITH_PAYLOAD:
            body = stream.take(length)
            if get("content-type", "").startswith("application/http"):
                body = body[body.find(b"\r\n\r\n") + 4 :]
            if verify and digest is not None and digest != base32_sha1(body):
                raise ValueError(f"the payload of {get('warc-record-id')} doesn't have its digest")
            stream.skip(4)
        else:
            stream.skip(length + 4)
        page, size = get("x-page-id"), get("x-payload-length")
        yield (
            int(page) if page is not None else None, kind, get("warc-record-id"), get("warc-target-uri"), get("warc-refers-to"), digest,
            len(body) if body is not None else int(size) if size is not None else None, body,
        )


_ARROW = pa.schema(
    [("page_id", pa.int64()), *[(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


@dataclass
class Archive(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        wanted = options.get("payload", "true")
        self.payload, self.decode = wanted == "true", wanted in ("true", "checked")
        self.verify = wanted == "checked" or options.get("verify", "false") == "true"
        self.group = int(options.get("groupbytes", 32 << 20))
        self.predicates: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            names = f.attribute if isinstance(f, (EqualTo, In)) else ()
            if len(names) == 1 and names[0] in _HEADERS and names[0] != "payload_digest":
                values = [f.value] if isinstance(f, EqualTo) else f.value
                self.predicates.append((_HEADERS[names[0]], {str(v) for v in values}))
            else:
                yield f

    def files(self) -> list[tuple[str, int]]:
        """(path, size) of the archives: those of the manifest, else those that the folder holds, else the file itself."""
        system, root = fs.FileSystem.from_uri(self.root)
        if system.get_file_info(root).type == fs.FileType.File:
            return [(root, system.get_file_info(root).size)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as f:
                return [(f"{root}/{name}", size) for name, size in json.loads(f.read())["files"]]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz"))]

    def partitions(self):
        groups: list[list[str]] = []
        held = self.group
        for path, size in sorted(self.files()):
            if held + size > self.group:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Archive(g) for g in groups or [[]]]

    def read(self, partition: Archive):
        system, _ = fs.FileSystem.from_uri(self.root)
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as source:
                rows, size = [], 0
                for row in read_records(source, self.predicates, self.decode, self.verify):
                    rows.append(row if self.payload else (*row[:-1], None))
                    size += 300 + (len(row[-1]) if self.payload and row[-1] else 0)
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    """Writes (page_id, url, payload, payload_digest, refers_to) rows."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.level = int(options.get("level", 1))
        self.most = int(options.get("filebytes", FILE_BYTES))

    def write(self, iterator):
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "payload_digest", "refers_to")]
            for row in zip(*(c.to_pylist() for c in columns)):
                if out is None or size >= self.most:
                    if out is not None:
                        out.close()
                        files.append((name, size))
                    name, size = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = gzip.compress(record(*row), self.level, mtime=0)
                out.write(member)
                size += len(member)
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages):
        system, root = fs.FileSystem.from_uri(self.root)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps({"files": [x for m in messages if m is not None for x in m.files]}).encode())

    def abort(self, messages):
        system, root = fs.FileSystem.from_uri(self.root)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """Format ``warc``; options ``path``, ``payload``, ``verify``, ``groupbytes``, ``level``, ``filebytes``.

    ``payload`` is true, false (skipped) or ``checked``: decoded, measured and held against its digest, but not handed on.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    bound_batches(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to) of pages.

    Of pages with equal payloads of at least ``at_least`` bytes that with the largest id stands for itself and the
    others refer to it.  A null html is an empty payload.  Pages with a null id stand for themselves; of rows that
    repeat the largest id with the same payload all stand for themselves.
    """

    @F.pandas_udf("string")
    def base32(digest):
        return digest.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    payload = F.encode(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32(F.sha1("payload")))
    work = Scratch(pages.sparkSession, "revisits")
    top = rows.where(F.octet_length("payload") >= at_least).groupBy("payload_digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    top = work.save(top, "top")
    total = top.agg(F.sum("n")).first()[0] or 0
    refers = F.when((F.col("page_id") != F.col("top")) & (F.octet_length("payload") >= at_least), F.col("top"))
    return hot_join(rows, top, ["payload_digest"], "n", total, ["page_id", "url"], "left").select("page_id", "url", "payload", "payload_digest", refers.alias("refers_to"))


def archive(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """Write the pages as archives into the shared folder, read them back and give every page's record without its payload."""
    spark = pages.sparkSession
    register(spark)
    work = Scratch(spark, "warc")
    path = work.path + "/archive"
    revisits(pages, at_least=at_least).write.format("warc").mode("append").option("path", path).save()
    back = spark.read.format("warc").option("path", path)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    responses = back.option("payload", "checked").load().where("record_type = 'response'")
    responses = work.save(responses.select("record_id", *columns), "responses")
    repeats = back.option("payload", "false").load().where("record_type = 'revisit'")
    repeats = work.save(repeats.select(*columns, F.col("refers_to").alias("record_id")), "revisits")
    # revisits name a record; its page is that of the response
    named = responses.groupBy("record_id").agg(F.max("page_id").alias("refers_to"))
    named = work.save(repeats.groupBy("record_id").agg(F.count("*").alias("n")).join(named, "record_id"), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    own = responses.select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(hot_join(repeats, named, ["record_id"], "n", total, ["page_id"], "left").drop("record_id"))
