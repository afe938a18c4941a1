"""WARC archives: a writer with revisit records and a splittable reader.

Writing: payloads with equal digests are found with one aggregate of (digest, smallest page_id); the first
page gets a ``response`` record, the others ``revisit`` records without a payload. Each task writes one
archive, one gzip member a record, under a temporary name and then renames it, so a task that runs again
replaces its own file. Folders are opened through pyarrow.fs, so any store it knows can be shared.

Reading: an archive is cut into byte ranges. A task looks for gzip magic numbers in its range, takes a
place for a member only if it inflates to a WARC header, and owns the records that start inside its
range, reading beyond the end for the last. No index is needed, and one large file is read by many tasks. (A whole WARC member that
stands uncompressed inside another one's data, where a range starts, cannot be told from a record.)
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
CHUNK = 1 << 16
MANIFEST = "path string, bytes long"
RECORDS = "path string, offset long, record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary"


def _open(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if folder.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub(r"^file:/*", "/", folder)
    return pyarrow.fs.FileSystem.from_uri(folder)


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _line(text: str) -> str:
    """A header is one line: line breaks in a URL are escaped."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header, which has the payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {_line(url)}"] if url is not None else []
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{_base32(hashlib.sha1(payload).digest())}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _info() -> bytes:
    block = b"software: tidewheel\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:info>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 6, mtime=0)


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the archives' paths and sizes.

    The payload is the html in UTF-8, empty for null. Of the records with equal payloads of ``least_bytes``
    or more, those with the smallest page_id are responses (all rows that share that id), the rest revisit
    it. A null page_id is never the smallest; where all are null, all are responses. A null url has no header.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("_html"), F.sha1(html.cast("binary")).alias("_digest"))
    # Only payloads that occur more than once have something to refer to; the aggregate combines before its shuffle.
    firsts = (
        pages.filter(F.octet_length(html) >= least_bytes)
        .groupBy(F.sha1(html.cast("binary")).alias("_digest"))
        .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
        .filter((F.col("_n") > 1) & F.col("_first").isNotNull())
    )
    marked = rows.join(firsts.drop("_n"), "_digest", "left").select("page_id", "url", "_html", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        files, path = _open(folder)
        name = f"{path}/part-{context.partitionId():06d}.warc.gz"
        files.create_dir(path, recursive=True)
        out, size = None, 0
        for batch in batches:
            for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{name}.{context.taskAttemptId()}", compression=None)
                    size = out.write(info := _info()) or len(info)
                data = member(page, url, html.encode(), first, first is not None and page != first)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            files.move(f"{name}.{context.taskAttemptId()}", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size]})

    return stash(marked.mapInArrow(run, MANIFEST)).withColumn("path", F.concat(F.lit(folder + "/"), F.element_at(F.split("path", "/"), -1)))


def _header(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        return None
    # Names are in any case, and a line that begins with a blank goes on with the field before it.
    fields: dict[str, str] = {}
    name = ""
    for x in lines[1:]:
        if x[:1] in (" ", "\t") and name:
            fields[name] += " " + x.strip()
        elif ":" in x:
            name, value = x.split(":", 1)
            fields[name := name.strip().lower()] = value.strip()
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _inflate(file, at: int, buffer: bytes, base: int) -> tuple[dict[str, str], bytes, int] | None:
    """Header, block and compressed length of the member at ``at``, or None if none starts there."""
    inflater, data = zlib.decompressobj(31), bytearray()
    fields, end, place, fed = None, -1, at - base, 0
    while not inflater.eof:
        chunk = buffer[place : place + CHUNK]
        if not chunk:
            chunk = file.read_at(CHUNK, base + place)
            if not chunk:
                if fields is None:
                    return None
                raise ValueError(f"the record at {at} is cut off")
        try:
            data += inflater.decompress(chunk)
        except zlib.error:
            if fields is None:
                return None
            raise
        place, fed = place + len(chunk), fed + len(chunk)
        if fields is None and (end := data.find(b"\r\n\r\n")) >= 0:
            fields = _header(bytes(data[:end]))
            if fields is None:
                return None
        elif fields is None and not b"WARC/1.".startswith(data[:7]):
            return None
    if fields is None:
        return None
    block = bytes(data[end + 4 : end + 4 + int(fields["content-length"])])
    if len(block) != int(fields["content-length"]):
        raise ValueError(f"the record at {at} is shorter than its header says")
    return fields, block, fed - len(inflater.unused_data)


def records_in(file, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, header and block of each record that starts in [start, end)."""
    buffer = file.read_at(end - start + CHUNK, start)
    at = buffer.find(MAGIC)
    while 0 <= at < end - start:
        found = _inflate(file, start + at, buffer, start)
        if found is None:
            at = buffer.find(MAGIC, at + 1)
            continue
        yield start + at, found[0], found[1]
        at = at + found[2]
        if buffer[at : at + 3] != MAGIC:
            at = buffer.find(MAGIC, at)


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def read(archives: DataFrame, range_bytes: int = RANGE_BYTES, most_tasks: int = 20_000) -> DataFrame:
    """The response and revisit records of ``archives`` (path, bytes), with payloads; a revisit's payload is null.

    A response's digest and length are those of the payload read, and a SHA-1 digest that differs from its header
    is an error; a revisit's come from its headers, null where those lack them. Other record types are passed over. Record ids of any form
    are kept as they are (``record_id``, ``refers_to_id``); the page numbers in them are null unless this writer made them.
    A block that is no HTTP message is a payload as a whole.
    """
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    tasks = ranges.count()
    ranges = ranges.select("path", "start", F.least("bytes", F.col("start") + range_bytes).alias("end")).repartition(max(1, min(tasks, most_tasks)), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, place = _open(path)
                rows: list[tuple] = []
                held = 0
                with files.open_input_file(place) as file:
                    for offset, fields, block in records_in(file, start, end):
                        kind = fields["warc-type"].lower()
                        if kind not in ("response", "revisit"):
                            continue
                        http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
                        algorithm, _, digest = (fields.get("warc-payload-digest") or "").rpartition(":")
                        if kind == "response":
                            size, own = len(payload), _base32(hashlib.sha1(payload).digest())
                            if digest and algorithm.lower() == "sha1" and len(digest) == len(own) and digest.upper() != own:
                                raise ValueError(f"the payload at {offset} of {path} does not have its digest")
                            digest = own
                        else:
                            stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
                            size, payload = int(stated[1]) if stated else None, None
                        ids = fields.get("warc-record-id"), fields.get("warc-refers-to")
                        rows.append((path, offset, ids[0], _page(ids[0]), fields.get("warc-target-uri"), kind, digest or None, size, ids[1], _page(ids[1]), payload))
                        held += len(payload or b"")
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return ranges.mapInArrow(run, RECORDS)


def _oracle() -> str:
    chunk = "('0x' || substr(hex, 5 * i + 1, 5))::BIGINT"
    letters = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(({chunk}) >> {s}) % 32 + 1]" for s in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
             array_to_string(list_transform(range(8), lambda i: {letters}), '') AS payload_digest,
             min(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""


ORACLE = _oracle()
