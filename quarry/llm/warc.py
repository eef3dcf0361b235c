"""WARC archives: a two-phase writer and a splittable reader as Spark data sources.

Every record is a gzip member of its own. A reading task gets a byte range, looks
for the gzip magic and validates a candidate: it must decode, under the member's
checksum, to a ``WARC/`` header whose Content-Length fits, and a further magic or
the end of the file must follow. In a range that starts inside a file, the members
from the first candidate on must in this way lead up to the range's end or to a
damaged one, as a payload may itself hold archives; else the next candidate is tried. The task owns
every record that starts inside its range, reading past its end for the last one.
Records of all types come back with their headers; an HTTP head is split off where
the content type names one.

The writer's tasks write files with names of their own and the commit lists them
in ``_MANIFEST``; files that a lost or repeated task leaves are not in it and are
never read.

Defined results: a null payload is empty; an empty table gives an archive
without records; payloads under ``min_bytes`` are always responses; repeated rows
of a group's smallest page id are all responses; a group whose page ids are all
null has no page to refer to and stays responses; a payload or header may have any
length (a task holds its range and one record); a member that is damaged, cut
short or no WARC record is stepped over; missing headers are null; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quarry.llm.common import new_folder, place, settle, small

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 16
MANIFEST = "_MANIFEST"
WRITTEN = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, record_id string, record_type string, url string, headers map<string,string>, http string, payload binary, payload_bytes long, payload_digest string, refers_to string, file string, position long"
#: Record ids of this writer.
PAGE_ID = r"^<urn:x-page:(-?[0-9]+)>$"


def record_bytes(row) -> bytes:
    """One WARC record as a gzip member."""
    kind, body = row.record_type, bytes(row.payload or b"") if row.record_type == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.payload_bytes}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{'' if row.page_id is None else row.page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{row.payload_digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row.url is not None:
        head.append(f"WARC-Target-URI: {' '.join(row.url.split())}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{row.refers_to}>"]
    head.append(f"Content-Length: {len(http) + len(body)}")
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n") + squeeze.flush()


def _headers(lines: bytes) -> dict[str, str]:
    """Names in lower case and values; a line that begins with white space goes on with the one before."""
    out, last = {}, None
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _number(told: str | None) -> int | None:
    return int(told) if told and told.isascii() and told.isdigit() else None


def parse_record(raw: bytes) -> tuple | None:
    """(page_id, record_id, record_type, url, headers, http, payload, payload_bytes, payload_digest, refers_to) of a decoded member, or None if it is no record.

    ``page_id`` is null in records of other writers. Of a revisit, bytes and digest are those of the payload it stands for, as far as its headers tell.
    """
    top, end, rest = raw.partition(b"\r\n\r\n")
    if not top.startswith(b"WARC/") or not end:
        return None
    warc = _headers(top)
    size = _number(warc.get("content-length"))
    if size is None or size > len(rest):
        return None
    payload, http, kind = rest[:size], None, warc.get("warc-type")
    if (warc.get("content-type") or "").lower().startswith("application/http"):
        head, _, payload = payload.partition(b"\r\n\r\n")
        http = head.decode("utf-8", "replace")
    page = re.fullmatch(PAGE_ID, warc.get("warc-record-id", ""))
    told = (int(page[1]) if page else None, warc.get("warc-record-id"), kind, warc.get("warc-target-uri"), warc, http)
    if kind == "revisit":
        digest = warc.get("warc-payload-digest")
        return *told, None, _number(_headers(head).get("content-length")) if http is not None else None, digest and digest.removeprefix("sha256:"), warc.get("warc-refers-to")
    return *told, payload, len(payload), hashlib.sha256(payload).hexdigest(), None


@dataclass
class ByteRange(InputPartition):
    file: str
    start: int
    end: int

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


class _Window:
    """Bytes of a file from a position on, fetched in chunks."""

    def __init__(self, source, position: int):
        self.source, self.base, self.data = source, position, bytearray()
        source.seek(position)

    def more(self) -> bool:
        got = self.source.read(CHUNK)
        self.data += got
        return bool(got)

    def find(self, at: int, end: int) -> int | None:
        """The first magic that starts in [at, end)."""
        while True:
            found = self.data.find(MAGIC, at - self.base, end - self.base + len(MAGIC) - 1)
            if found >= 0:
                return self.base + found
            at = max(at, self.base + len(self.data) - len(MAGIC) + 1)
            if at >= end or not self.more():
                return None

    def follows(self, at: int) -> bool:
        """Whether a magic or the end of the file is at ``at``."""
        while len(self.data) < at - self.base + len(MAGIC) and self.more():
            pass
        return bytes(self.data[at - self.base : at - self.base + len(MAGIC)]) in (MAGIC, b"")


#: A member that begins as gzip but doesn't decode.
DAMAGED = ()


def _member(window: _Window, at: int) -> tuple[bytes, int] | tuple[()] | None:
    """The decoded member that starts at ``at`` and the position after it if it is a whole WARC record, else DAMAGED or None."""
    decode, out, size, done = zlib.decompressobj(31), [], 0, at - window.base
    try:
        while not decode.eof:
            if done == len(window.data) and not window.more():
                return DAMAGED
            fed = bytes(window.data[done : done + CHUNK])
            done += len(fed)
            out.append(decode.decompress(fed))
            size += len(out[-1])
            if size >= 5 and size - len(out[-1]) < 5 and not b"".join(out).startswith(b"WARC/"):
                return None
    except zlib.error:
        return DAMAGED
    raw, after = b"".join(out), window.base + done - len(decode.unused_data)
    return (raw, after) if parse_record(raw) and window.follows(after) else None


def _leads_on(window: _Window, at: int, end: int) -> bool:
    """Whether whole records follow each other from ``at`` to ``end``, to the end of the file or to a damaged one."""
    begin = at
    while at < end:
        found = _member(window, at)
        if not found:
            return found is not None and at > begin
        at = found[1]
        if at - window.base >= len(window.data):
            return True
    return True


def records_in(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, decoded record) of the members that start in [start, end)."""
    window, at, sure = _Window(source, start), start, start == 0
    first, tried = window.find(at, end), None
    if not sure:  # the first candidate from which records lead up to the end; without one, each stands for itself
        tried = first
        while tried is not None and not _leads_on(window, tried, end):
            tried = window.find(tried + 1, end)
    at = first if tried is None else tried
    while at is not None and at < end:
        found = _member(window, at)
        if found:
            yield at, found[0]
        at = window.find(found[1] if found else at + 1, end)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitbytes", 16 << 20))

    def partitions(self) -> list[ByteRange]:
        store, top = place(self.path)
        manifest = f"{top}/{MANIFEST}"
        if store.get_file_info(top).type == fs.FileType.File:
            files = [(top, store.get_file_info(top).size)]
        elif store.get_file_info(manifest).type == fs.FileType.File:
            with store.open_input_stream(manifest) as f:
                files = [(f"{top}/{x['file']}", x["size"]) for x in map(json.loads, f.read().decode().splitlines())]
        else:
            files = [(x.path, x.size) for x in store.get_file_info(fs.FileSelector(top)) if x.path.endswith(".warc.gz")]
        return [ByteRange(f, at, min(at + self.split, size)) for f, size in sorted(files) for at in range(0, size, self.split)] or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[tuple]:
        if not part.file:
            return
        store, _ = place(self.path)
        with store.open_input_file(part.file) as source:
            for at, raw in records_in(source, part.start, part.end):
                yield (*parse_record(raw), part.file.rpartition("/")[2], at)


@dataclass
class Wrote(WriterCommitMessage):
    file: str
    size: int

    def __init__(self, file: str, size: int):
        self.file, self.size = file, size


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows) -> Wrote:
        store, top = place(self.path)
        store.create_dir(top, recursive=True)
        name, size = f"{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{top}/{name}", compression=None) as sink:
            for row in rows:
                size += sink.write(record_bytes(row))
        return Wrote(name, size)

    def commit(self, messages) -> None:
        store, top = place(self.path)
        store.create_dir(top, recursive=True)
        with store.open_output_stream(f"{top}/{MANIFEST}", compression=None) as f:
            f.write("".join(json.dumps({"file": m.file, "size": m.size}) + "\n" for m in messages if m is not None and m.size).encode())

    def abort(self, messages) -> None:
        store, top = place(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{top}/{m.file}")


class Warc(DataSource):
    """Format ``warc``: options ``path`` and, to read, ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()})


def with_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Rows to write: of equal payloads the smallest page id keeps its bytes, the others point to it.

    Equal payloads are found by their SHA-256 over (page_id, digest) rows, counted
    before the shuffle, so that a payload which a third of the pages share is one
    row for each task. The html moves only if the table of repeated digests is too
    large to broadcast.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    repeated = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = small(settle(repeated.where("n > 1 and first is not null").select("payload_digest", "first")), 120)
    rows = rows.join(repeated, "payload_digest", "left")
    again = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    return rows.select(
        "page_id",
        "url",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_bytes",
        "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 100) -> str:
    pages.sparkSession.dataSource.register(Warc)
    with_revisits(pages, min_bytes).write.format("warc").mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, split_bytes: int = 16 << 20) -> DataFrame:
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("splitBytes", split_bytes).load(path)


def archive_round_trip(pages: DataFrame, min_bytes: int = 100, split_bytes: int = 4 << 20) -> DataFrame:
    """Archive the pages in the shared folder and describe the records that read back."""
    spark = pages.sparkSession
    path = write_archives(pages, new_folder(spark, "quarry-warc"), min_bytes)
    refers_to = F.regexp_extract("refers_to", PAGE_ID, 1).try_cast("long").alias("refers_to")
    return read_archives(spark, path, split_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", refers_to)


#: What reads back, in DuckDB.
SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND f.first <> p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.h = p.h
"""
