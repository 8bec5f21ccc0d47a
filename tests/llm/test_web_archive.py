import gzip
import io
import zipfile

import pyarrow as pa
import pytest

from voltlake.llm import web_archive as W


def reader(data: bytes):
    return pa.BufferReader(data), len(data)


class File:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_round_trip(spark):
    rows = [(k, f"http://x/{k}?a=ü\r\n", h, "p") for k, h in enumerate(["<p>a</p>", "b", "<p>a</p>", "", None, "ünï\r\n\r\nx", "b", "long " * 50000])]
    rows += [(3, None, "", "p"), (None, "http://null", "b", "p"), (7, "http://again", "long " * 50000, "p")]
    manifest = W.write_archives(pages(spark, rows), package_bytes=1000)
    assert manifest.count() > 1
    got = W.read_archives(manifest).collect()
    assert len(got) == len(rows)
    top = {}
    for p, _, h, _ in rows:
        if p is not None:
            top[h or ""] = max(top.get(h or "", p), p)
    for r in got:
        own = [h or "" for p, _, h, _ in rows if p == r.page_id and len((h or "").encode()) == r.payload_bytes]
        assert own and r.payload_digest == W.base32_sha1(own[0].encode())
        if r.page_id is None or r.page_id == top[own[0]]:
            assert r.record_type == "response" and r.refers_to is None and bytes(r.payload) == own[0].encode()
        else:
            assert r.record_type == "revisit" and r.refers_to == top[own[0]] and r.payload is None


def test_hot_payload_without_broadcast(spark):
    rows = [(k, f"http://x/{k}", "same" if k % 3 else f"own {k}", "p") for k in range(900)]
    for limit in (400_000, 0):
        got = W.read_archives(W.write_archives(pages(spark, rows).repartition(4), broadcast_rows=limit)).collect()
        assert sorted(r.page_id for r in got) == list(range(900))
        assert [r.page_id for r in got if r.record_type == "response" and bytes(r.payload) == b"same"] == [899]
        assert all(r.refers_to == (899 if r.page_id % 3 and r.page_id < 899 else None) for r in got)


def test_several_members_indexes_and_record_types():
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    record = lambda kind, block, more="": f"WARC/1.1\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    records = [record("warcinfo", b"software: x\r\n\r\nmore"), record("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n"), record("response", http), record("resource", b"plain"), record("revisit", b"", "WARC-Payload-Digest: sha1:ABC\r\nWARC-Refers-To: <urn:page:5>\r\n")]
    packed = [gzip.compress(r) for r in records]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(packed[:3]))
        z.writestr("archive/two.warc.gz", b"".join(packed[3:]))
        z.writestr("archive/three.warc", b"".join(records))
        lines = [f'com,x)/ 2024 {{"offset": "{sum(map(len, packed[:k]))}", "length": "{len(packed[k])}", "filename": "one.warc.gz"}}' for k in (2, 0, 1)]
        z.writestr("indexes/a.cdxj.gz", gzip.compress("\n".join(["!meta", *lines]).encode()))
        z.writestr("datapackage.json", "{}")
    got = list(W.read_package(File(out.getvalue()), len(out.getvalue())))
    short = [(r["record_type"], r["payload"], r["payload_bytes"]) for r in got]
    all_five = [("warcinfo", b"software: x\r\n\r\nmore", 19), ("request", b"", 0), ("response", b"hello", 5), ("resource", b"plain", 5), ("revisit", None, None)]
    assert short == [all_five[2], all_five[0], all_five[1], *all_five, *all_five[3:]]
    assert (got[-1]["refers_to"], got[-1]["payload_digest"], got[-1]["page_id"], got[-1]["record_id"]) == (5, "ABC", None, "<urn:uuid:revisit>")


def test_empty(spark):
    assert W.read_archives(W.write_archives(pages(spark, []))).count() == 0


def test_directory_of_many_members_is_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k in range(65_600):
            z.writestr(f"m{k}", b"")
        z.writestr("last", b"here")
    data = out.getvalue()
    assert b"PK\x06\x06" in data
    found = W.directory(File(data), len(data))
    start = W.member_start(File(data), found["last"][0])
    assert len(found) == 65_601 and data[start : start + found["last"][1]] == b"here"


def test_zip64_extra_field_gives_large_values():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", b"abc")
    data = bytearray(out.getvalue())
    entry = data.index(b"PK\x01\x02")
    # offset and sizes moved into the extra field, as for large members
    extra = b"\x01\x00\x18\x00" + (3).to_bytes(8, "little") * 2 + (0).to_bytes(8, "little")
    data[entry + 20 : entry + 28] = b"\xff" * 8
    data[entry + 42 : entry + 46] = b"\xff" * 4
    data[entry + 30 : entry + 32] = len(extra).to_bytes(2, "little")
    data[entry + 47 : entry + 47] = extra
    end = data.index(b"PK\x05\x06")
    data[end + 12 : end + 16] = (end - entry).to_bytes(4, "little")
    assert W.directory(File(bytes(data)), len(data)) == {"a": (0, 3, 0)}


def test_compressed_members_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(W.DATA, b"x" * 100)
        z.writestr(W.INDEX, b"")
    with pytest.raises(ValueError, match="stored"):
        list(W.read_package(File(out.getvalue()), len(out.getvalue())))
    with pytest.raises(ValueError, match="end of central"):
        W.directory(File(b"nothing"), 7)
