"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader decompresses an archive incrementally, member by member, frames each record by its Content-Length, and
verifies its block and payload digests. Pages with equal payloads become one response record, of the
smallest page id, and revisit records that refer to it and keep its HTTP header (so also its length), not the payload.

Archives are ``.warc.gz`` files in one folder, each a warcinfo record and records up to about ``ARCHIVE_BYTES``. Tasks write them
themselves, to any store that pyarrow opens by its address (mounted folders, HDFS, S3, GCS). Names tell partition and attempt; the
table of what was written (a row for each archive) is kept by Spark, so files of lost or repeated attempts are never read.

Defined cases: a null payload is empty; of pages with equal payloads and the smallest id, repeated rows are responses
each; pages without an id are responses; a null url gives a record without a target; a damaged or cut record raises.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import store
from .common import checkpoint_dir, cut, hot_join, to_batch

ARCHIVE_BYTES, STEP = 4 << 20, 64 << 10
SOFTWARE = "wordweir"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

ARCHIVES = "archive string, part bigint, attempt bigint, records bigint, bytes bigint"
_ARCHIVES = pa.schema([("archive", pa.string()), *((n, pa.int64()) for n in ("part", "attempt", "records", "bytes"))])
RECORDS = (
    "archive string, record_id string, record_type string, target string, refers_to string, "
    "payload_bytes bigint, payload_digest string, payload binary"
)
_RECORDS = pa.schema(
    [(n, pa.string()) for n in ("archive", "record_id", "record_type", "target", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


class WarcError(ValueError):
    """A record whose framing or digest is wrong."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _pressed(head: list[tuple[str, str]], block: bytes) -> bytes:
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))]) + "\r\n"
    squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
    return squeeze.compress(raw.encode("utf-8", "replace") + block + b"\r\n\r\n") + squeeze.flush()


def info(name: str, date: str) -> bytes:
    """The record that an archive begins with."""
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    head = [
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date),
        ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    return _pressed(head, block)


def record(page_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One compressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{page_id}>"), ("WARC-Date", date),
        ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    return _pressed(head, block)


def members(content: bytes) -> Iterator[bytes]:
    """The decompressed gzip members one after another; one is in memory at a time."""
    at = 0
    view = memoryview(content)
    while at < len(content):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(content):
                raise WarcError("the archive ends within a record")
            piece = view[at : at + STEP]
            try:
                parts.append(inflate.decompress(piece))
            except zlib.error as e:
                raise WarcError(str(e)) from e
            at += len(piece) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(member: bytes) -> dict | None:
    """Headers and payload of a record, its length and digests verified; None for a warcinfo record."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC header")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not fit the record")
    if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError("wrong block digest")
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload) != length or sha1_base32(payload) != digest):
        raise WarcError("wrong payload digest")
    own = lambda x: None if x is None else x[1:-1].removeprefix(URN)
    target = fields.get("WARC-Target-URI")
    return {
        "record_id": own(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"],
        "target": target and target.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "refers_to": own(fields.get("WARC-Refers-To")),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if response else None,
    }


def first_pages(pages: DataFrame, id_col: str, payload_col: str) -> DataFrame:
    """(page_digest, first, size): for each payload of several pages the smallest id, and how many they are."""
    digest = F.sha1(F.coalesce(F.col(payload_col), F.lit("")).cast("binary"))
    return pages.select(digest.alias("page_digest"), F.col(id_col).alias("id")).groupBy("page_digest").agg(
        F.min("id").alias("first"), F.count("*").alias("size")
    ).where("size > 1")


def write_archives(
    pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES, date: str | None = None,
) -> DataFrame:
    """Every page as a record in archives of ``folder`` (default: a new one in the shared checkpoint folder); a row for each archive, see ARCHIVES.

    A payload that many pages share is no hot spot: its pages are not shuffled.
    """
    folder = (folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}").rstrip("/")
    date = date or now()
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("page_digest"))
    first = cut(first_pages(pages, id_col, payload_col))
    rows = hot_join(rows, first, "page_digest", first.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], "left")
    refers = F.when(F.col("first") != F.col("id"), F.col("first").cast("string"))
    rows = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", refers.alias("refers_to"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, k = [], 0, 0
        task = TaskContext.get()
        part_id, attempt = task.partitionId(), task.taskAttemptId()
        system, base = store(folder)

        def full() -> pa.RecordBatch:
            name = f"part-{part_id:06d}-{attempt}-{k:06d}.warc.gz"
            if not k:
                system.create_dir(base, recursive=True)
            content = b"".join([info(name, date), *held])
            with system.open_output_stream(f"{base}/.{name}", compression=None) as out:
                out.write(content)
            system.move(f"{base}/.{name}", f"{base}/{name}")
            return to_batch([(f"{folder}/{name}", part_id, attempt, len(held), len(content))], _ARCHIVES)

        for part in parts:
            for i in range(part.num_rows):
                page_id, url, body, refers_to = (c[i].as_py() for c in part.columns)
                held.append(record("" if page_id is None else page_id, url, body, refers_to, date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield full()
                    held, size, k = [], 0, k + 1
        if held:
            yield full()

    return cut(rows.mapInArrow(run, ARCHIVES))


def archive_files(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """(archive, content) of the files of ``write_archives``; no others in their folder."""
    one = archives.select("archive").first()
    if one is None:
        return spark.createDataFrame([], "archive string, content binary")
    folder = one["archive"].rpartition("/")[0]
    files = spark.read.format("binaryFile").load(f"{folder}/*.warc.gz").select(F.col("path").alias("archive"), "content")
    number = lambda k: F.element_at(F.split(F.element_at(F.split("archive", "/"), -1), "-"), k).cast("bigint")
    # one attempt counts for each partition: a row of two numbers for each task of the writer
    good = archives.select("part", "attempt").distinct()
    return files.withColumns({"part": number(2), "attempt": number(3)}).join(F.broadcast(good), ["part", "attempt"], "left_semi").select("archive", "content")


def read_archives(files: DataFrame) -> DataFrame:
    """One row for each record of (archive, content) rows, warcinfo records left out; see RECORDS."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column("archive"), part.column("content"), strict=True):
                held, size = [], 0
                for member in members(content.as_py()):
                    r = parse(member)
                    if r is None:
                        continue
                    held.append((name.as_py(), *(r[f] for f in _RECORDS.names[1:])))
                    size += r["payload_bytes"]
                    if size >= ARCHIVE_BYTES:
                        yield to_batch(held, _RECORDS)
                        held, size = [], 0
                if held:
                    yield to_batch(held, _RECORDS)

    return files.select("archive", "content").mapInArrow(run, RECORDS)
