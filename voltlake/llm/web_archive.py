"""WARC in ZIP packages: write page records into archives, and read them back by directory and range.

Writing: pages with equal payloads are found by digest; the one with the largest page_id becomes a
``response`` record, the others ``revisit`` records that refer to it. Each task writes ZIP packages of a
bounded size into the shared folder, with stored (uncompressed) members ``archive/data.warc.gz`` (one
gzip member per record) and ``indexes/index.cdxj`` (offset and length per record); a manifest table
lists the packages of the attempts that counted, so a repeated task leaves at most an orphan file.

Reading: the end record, the ZIP64 locator and end record, and the central directory are parsed from
ranges at the end of a package; members are located by their local headers; the lines of all indexes (plain or gzip) name
the archive member, offset and length of the records, each read alone. An archive that no index line names is read
record by record from its start. Nothing is extracted. Files are opened through
``pyarrow.fs``, so a package can lie on any file system that has a URI.

Record types: of ``response``, ``revisit`` and ``request`` the payload is what follows the HTTP header, of all others (``warcinfo``,
``resource``, ``metadata``, ...) the whole block. A revisit has no payload of its own; its size is what its HTTP header says, else null.

Null html is an empty payload. Rows with null page_id are written, refer to nothing and are never referred
to (they are responses). Repeated rows: all rows with the largest page_id of a payload are responses.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import bounded, discard, shared_dir, staged, table

PACKAGE_BYTES = 16 << 20
BROADCAST_ROWS = 400_000  # of a digest and an id each
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"


# ---- records


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit (refers_to given) has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~-._''')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """record_id, page_id (of an id ``<urn:page:N>``), record_type, url, payload (None for a revisit), payload_bytes, payload_digest, refers_to."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    kind = fields.get("warc-type", "")
    http, _, body = block.partition(b"\r\n\r\n")
    spoken = kind in ("response", "revisit", "request") and block.startswith((b"HTTP/", b"GET ", b"POST ", b"HEAD ", b"PUT "))
    payload = body if spoken else block
    out = {"record_id": fields.get("warc-record-id"), "page_id": _page(fields.get("warc-record-id")), "record_type": kind, "url": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to"))}
    if kind == "revisit":
        said = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        digest = fields.get("warc-payload-digest", "")
        return out | {"payload": None, "payload_bytes": int(said[0]) if said and said[0].isdigit() else None, "payload_digest": digest.removeprefix("sha1:") or None}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload)}


def _page(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.removeprefix("-").isdigit() else None


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---- packages


def write_package(stream, records: list[tuple[str, bytes]]) -> None:
    """A ZIP with stored members: records (index key, record) as gzip members, and their index."""
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        lines, at = [], 0
        with z.open(zipfile.ZipInfo(DATA, (2024, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
            for key, record in records:
                squeeze = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = squeeze.compress(record) + squeeze.flush()
                member.write(data)
                lines.append(f"{key} {json.dumps({'filename': DATA.removeprefix('archive/'), 'offset': at, 'length': len(data)})}\n")
                at += len(data)
        z.writestr(zipfile.ZipInfo(INDEX, (2024, 1, 1, 0, 0, 0)), "".join(lines))


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (local header offset, stored length, compression method), from the end and central directory records."""
    tail_at = max(0, size - (22 + 65535 + 20))
    tail = file.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack("<HLL", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        at = struct.unpack("<Q", tail[end - 12 : end - 4])[0]
        far = file.read_at(56, at)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("bad ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", far[32:56])
    data, found, at = file.read_at(length, start), {}, 0
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory entry")
        method, packed, plain = struct.unpack("<H", data[at + 10 : at + 12])[0], *struct.unpack("<LL", data[at + 20 : at + 28])
        n, m, c = struct.unpack("<HHH", data[at + 28 : at + 34])
        offset = struct.unpack("<L", data[at + 42 : at + 46])[0]
        name, extra = data[at + 46 : at + 46 + n].decode(), data[at + 46 + n : at + 46 + n + m]
        while len(extra) >= 4:
            kind, width = struct.unpack("<HH", extra[:4])
            if kind == 1:  # holds, in this order, those of the three that don't fit above
                values = iter(struct.unpack(f"<{width // 8}Q", extra[4 : 4 + width // 8 * 8]))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + width :]
        found[name] = (offset, packed, method)
        at += 46 + n + m + c
    return found


def member_start(file, offset: int) -> int:
    """Where a member's data begin: after its local header."""
    head = file.read_at(30, offset)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, m = struct.unpack("<HH", head[26:30])
    return offset + 30 + n + m


def read_package(file, size: int) -> Iterator[dict]:
    """The records of a package: those that index lines name, then those of archives without an index."""
    members = directory(file, size)
    archives = {n.removeprefix("archive/"): m for n, m in members.items() if n.startswith("archive/") and m[1]}
    indexes = sorted(n for n in members if n.startswith("indexes/") and n.removesuffix(".gz").endswith((".cdxj", ".cdx", ".idx")))
    if any(members[n][2] for n in indexes) or any(m[2] for m in archives.values()):
        raise ValueError("members must be stored")
    starts = {n: member_start(file, m[0]) for n, m in archives.items()}
    named: set[str] = set()
    for index in indexes:
        text = file.read_at(members[index][1], member_start(file, members[index][0]))
        for line in (zlib.decompress(text, 31) if index.endswith(".gz") else text).decode().splitlines():
            if "{" not in line:
                continue
            place = json.loads(line[line.index("{") :])
            name = place.get("filename", next(iter(archives)) if len(archives) == 1 else None)
            if name not in archives:
                raise ValueError(f"an index names an archive that isn't there: {name}")
            named.add(name)
            yield parse_record(_plain(file.read_at(int(place["length"]), starts[name] + int(place["offset"]))))
    for name in sorted(archives.keys() - named):
        yield from _in_order(file, starts[name], archives[name][1])


def _plain(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == b"\x1f\x8b" else data


def _in_order(file, start: int, length: int, step: int = 1 << 20) -> Iterator[dict]:
    """Records of an archive from its start: gzip members, or plain records by their lengths."""
    held, at = b"", 0
    compressed = file.read_at(min(2, length), start) == b"\x1f\x8b"
    squeeze, record = zlib.decompressobj(31), b""
    while at < length or held:
        if at < length:
            held += file.read_at(min(step, length - at), start + at)
            at += min(step, length - at)
        if compressed:
            record += squeeze.decompress(held)
            held = squeeze.unused_data
            if squeeze.eof:
                yield parse_record(record)
                squeeze, record = zlib.decompressobj(31), b""
            elif at >= length:
                raise ValueError("an archive ends inside a record")
        else:
            while (cut := held.find(b"\r\n\r\n")) >= 0:
                size = next(int(x.split(b":")[1]) for x in held[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
                if len(held) < cut + 8 + size:
                    break
                yield parse_record(held[: cut + 4 + size])
                held = held[cut + 8 + size :]
            if at >= length and held:
                raise ValueError("an archive ends inside a record")


# ---- Spark


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, bytes]] = []
        size = 0

        def flush():
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            system, path = fs.FileSystem.from_uri(uri)
            with system.open_output_stream(path) as out:
                write_package(out, held)
            done = pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [system.get_file_info(path).size], "records": [len(held)]})
            held.clear()
            return done

        for batch in batches:
            cols = [batch.column(k) for k in range(4)]
            for r in range(batch.num_rows):
                page, url, html, keeper = (c[r].as_py() for c in cols)
                payload = (html or "").encode()
                held.append((str(page), record_bytes(page, url, payload, base32_sha1(payload), keeper)))
                size += len(held[-1][1])
                if size >= limit:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, page_id="page_id", url="url", html="html", package_bytes=PACKAGE_BYTES, broadcast_rows=BROADCAST_ROWS) -> DataFrame:
    """Writes all rows and returns the manifest: uri, bytes, records. Shared digests are broadcast up to ``broadcast_rows``, else pages are shuffled by digest."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/voltlake/archives-{uuid.uuid4().hex}"
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha2("html", 256)))
    # digests alone are grouped; of these only those that several pages share go back to the pages
    keepers = rows.groupBy("key").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "keeper")
    keepers = staged(keepers, "keepers")
    rows = rows.join(bounded(keepers, broadcast_rows), "key", "left")
    refers = F.when(F.col("page_id") < F.col("keeper"), F.col("keeper"))
    made = rows.select("page_id", "url", "html", refers.alias("refers_to")).mapInArrow(_writer(folder, package_bytes), "uri string, bytes long, records long")
    out = staged(made, "manifest")
    discard(keepers)
    return out


READ = "record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def _reader(with_payload: bool):
    names = [x.split()[0] for x in READ.split(", ") if with_payload or not x.startswith("payload ")]
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, path = fs.FileSystem.from_uri(row["uri"])
                with system.open_input_file(path) as file:
                    held: list[dict] = []
                    for record in read_package(file, row["bytes"]):
                        held.append(record)
                        if len(held) == 1000:
                            yield _batch(held)
                            held = []
                    if held:
                        yield _batch(held)

    def _batch(held):
        return pa.RecordBatch.from_pydict({n: pa.array([r[n] for r in held], kinds.get(n, pa.string())) for n in names})

    return run


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the packages: record_id, page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    schema = ", ".join(x for x in READ.split(", ") if with_payload or not x.startswith("payload "))
    many = max(1, min(manifest.count(), 10_000))
    return manifest.repartition(many, "uri").mapInArrow(_reader(with_payload), schema)


def op4_warc(spark, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_warc": op4_warc}
ORACLE = {
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages),
d AS (SELECT *, sha1(h) AS x FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5)) AS INTEGER) >> s) & 31 AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to
FROM d"""
}
