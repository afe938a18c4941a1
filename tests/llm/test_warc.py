import base64
import gzip
import hashlib
import os
import random

import pyarrow.fs
import pytest

from tidewheel.llm import warc
from tidewheel.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, bytes int, path string"


def want(rows, least=0):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None)
        revisit = first is not None and page != first and len(data) >= least
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [97, 4096, 1 << 22])
def test_round_trip(spark, range_bytes):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}\n", "".join(rng.choice("ab<é>\r\n") for _ in range(rng.randrange(300))), 1, "p") for i in range(200)]
    rows += [(500 + i, None, rows[i % 3][2], 1, "p") for i in range(60)] + [(900, "u", None, 1, "p"), (901, "u", "", 1, "p"), (None, "u", "", 1, "p")]
    rows += [(902, "u", "".join(chr(rng.randrange(32, 0x4000)) for _ in range(60_000)), 1, "p"), (903, "u", "WARC/1.1\r\n\r\n" * 9, 1, "p"), (903, "u", "WARC/1.1\r\n\r\n" * 9, 1, "p")]
    archives = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(3), shared_folder(spark))
    got = warc.read(archives, range_bytes).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
    texts = {p: h for p, _, h, *_ in rows}
    assert all(bytes(r.payload).decode() == (texts[r.page_id] or "") for r in got if r.record_type == "response")
    assert {r.url for r in got if r.page_id == 3} == {"http://x/3%0A"}


def test_least_bytes_and_empty(spark):
    rows = [(1, "u", "same", 1, ""), (2, "u", "same", 1, ""), (3, "u", "longer text", 1, ""), (4, "u", "longer text", 1, "")]
    got = warc.read(warc.write(spark.createDataFrame(rows, SCHEMA), shared_folder(spark), 5)).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA), shared_folder(spark))).collect() == []


def test_false_magic_and_standard_gzip(tmp_path):
    """Magic numbers inside a stored payload are no records, and any gzip reader can read an archive."""
    noise = b"\x1f\x8b\x08" * 500
    stored = gzip.compress(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 1500\r\n\r\n" + noise + b"\r\n\r\n", 0)
    data = stored + warc.member(7, "u", b"hello", None, False) + stored + warc.member(8, "u", b"hello", 7, True)
    (tmp_path / "a.warc.gz").write_bytes(data)
    assert gzip.decompress(data).count(b"WARC/1.1") == 4
    with pyarrow.fs.LocalFileSystem().open_input_file(os.fspath(tmp_path / "a.warc.gz")) as file:
        for step in (50, 333, 5000):
            offsets = [o for s in range(0, len(data), step) for o, _, _ in warc.records_in(file, s, min(s + step, len(data)))]
            assert len(offsets) == 4 and offsets[0] == 0
        with pytest.raises(ValueError):
            (tmp_path / "b").write_bytes(data[:-20])
            with pyarrow.fs.LocalFileSystem().open_input_file(os.fspath(tmp_path / "b")) as cut:
                list(warc.records_in(cut, 0, len(data)))


def test_archives_of_other_writers(spark, tmp_path):
    def record(head, block):
        return gzip.compress("\r\n".join(["WARC/1.0", *head, f"content-length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    data = record(["WARC-Type: request", "WARC-Record-ID: <urn:uuid:0>"], b"GET / HTTP/1.1\r\n\r\n")
    data += record(["warc-TYPE: response", "warc-record-id: <urn:uuid:1>", "WARC-Target-URI:http://a/", "X-Long: one", " two"], http + b"body\r\n\r\nmore")
    data += record(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:2>", "WARC-Payload-Digest: md5:abc"], b"plain block")
    data += record(["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:3>", "WARC-Refers-To: <urn:uuid:1>"], http)
    data += record(["WARC-Type: revisit", "WARC-Payload-Digest: sha1:ABC"], b"")
    (tmp_path / "other.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/other.warc.gz", len(data))], warc.MANIFEST)
    for step in (60, 1 << 20):
        got = sorted(warc.read(files, step).collect(), key=lambda r: r.offset)
        digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert [(r.record_id, r.page_id, r.url, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to_id, r.payload and bytes(r.payload)) for r in got] == [
            ("<urn:uuid:1>", None, "http://a/", "response", digest(b"body\r\n\r\nmore"), 12, None, b"body\r\n\r\nmore"),
            ("<urn:uuid:2>", None, None, "response", digest(b"plain block"), 11, None, b"plain block"),
            ("<urn:uuid:3>", None, None, "revisit", None, None, "<urn:uuid:1>", None),
            (None, None, None, "revisit", "ABC", None, None, None),
        ]
