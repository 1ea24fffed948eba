"""Operator 4: legacy ARC archives to WARC, and WARC archives read back.

An ARC file opens with a ``filedesc:`` record that names its version; the header line of every
later record has the fields of that version, the last of them the declared length of what
follows. The parser takes exactly that many bytes, whatever they look like. Each record
becomes a WARC record with a synthesised identifier, timestamp (ISO 8601 from the 14 digits),
type and SHA-1 digests in base 32 (of the whole block, and of the payload behind HTTP headers).

pages_to_warc() writes a table of pages as gzip-compressed WARC files in the shared
folder, by way of ARC records: each page is laid out as an ARC record (version 1 or 2 by turns,
by its page_id), parsed by its version, and converted. Of pages with equal payloads of
``least_bytes`` or more, the one with the largest page_id is a ``response`` and the others
``revisit`` it: the HTTP headers stay, the payload goes, digest and length stay known. Which
payloads are shared is found from digests alone (a partial aggregate); they reach the pages
by a broadcast if their measured size is below ``broadcast_bytes``, else by a join on the digest.

Files are read back whole, one row a file, and decompressed a piece at a time; writers keep
files small: the mean size of the payloads is measured first, and a file has as many records as
have about ``file_bytes`` before compression, ``records_per_file`` at most.

Cases: null html is an empty payload; a null url is ``-``, and blanks and control characters
in urls are percent-encoded; pages that share the largest page_id of a payload (repeated rows)
are all responses; a null page_id counts as smaller than any other and stays null. An
empty table gives archives without records. Other columns are ignored.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scratch import new_path, saved

#: Field names of the header lines, fixed by the format's versions.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
LEAST_BYTES, BROADCAST_BYTES, RECORDS_PER_FILE, FILE_BYTES = 0, 16 << 20, 20_000, 256 << 20
_KEY = b"X-Archive-Key:"
READ = "page_id long, url string, warc_date string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


class ArcError(ValueError):
    """An archive that its declared versions and lengths don't describe."""


def arc_date(moment: datetime.datetime) -> str:
    return moment.strftime("%Y%m%d%H%M%S")


def arc_file_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 lodestone\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, block: bytes, offset: int = 0, name: str = "-") -> bytes:
    fields = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200",
              "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(block))}
    return b"\n" + " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + block


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the filedesc record included."""
    at, version = 0, 0
    while True:
        while at < len(data) and data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ArcError(f"no end of the header line at byte {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        at = end + 1
        if not version:
            if not values[0].startswith("filedesc:"):
                raise ArcError("the first record is no filedesc")
            length = int(values[-1])
            version = int(data[at : at + length].split(b" ", 1)[0])
            if version not in ARC_FIELDS:
                raise ArcError(f"ARC version {version}")
            names = ARC_FIELDS[1] if len(values) == len(ARC_FIELDS[1]) else ARC_FIELDS[version]
        else:
            names = ARC_FIELDS[version]
        if len(values) != len(names):
            raise ArcError(f"{len(values)} fields in a header line of version {version}")
        fields = dict(zip(names, values))
        if not fields["Archive-length"].isdigit() or at + int(fields["Archive-length"]) > len(data):
            raise ArcError(f"declared length {fields['Archive-length']}, {len(data) - at} bytes are there")
        length = int(fields["Archive-length"])
        yield ArcRecord(version, fields, data[at : at + length])
        at += length


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def key_urn(key: int) -> str:
    """An identifier (UUID of version 8) that holds a 64-bit key."""
    key &= (1 << 64) - 1
    high = (0x6C6F6465 << 32) | (0x7374 << 16) | (8 << 12) | (key >> 62)
    n = (high << 64) | (2 << 62) | (key & ((1 << 62) - 1))
    h = f"{n:032x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def urn_key(urn: str) -> int | None:
    """The key of an identifier of key_urn(), None for others."""
    h = re.sub("[^0-9a-f]", "", urn.partition("uuid:")[2])
    if len(h) != 32 or not h.startswith("6c6f646573748"):
        return None
    key = ((int(h[13:16], 16) & 3) << 62) | (int(h[16:], 16) & ((1 << 62) - 1))
    return key - (1 << 64) if key >> 63 else key


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    if not block.startswith(b"HTTP/"):
        return b"", block
    head, found, payload = block.partition(END)
    return (head + found, payload) if found else (block, b"")


def _http_value(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb"[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def arc_to_warc(record: ArcRecord, revisit_of: str | None = None) -> bytes:
    """The WARC record (without the blank lines behind it) of an ARC record; with
    ``revisit_of``, an identifier, a revisit of that record without the payload."""
    f = record.fields
    url = f["URL"]
    moment = f["Archive-date"].ljust(14, "0")[:14]
    date = f"{moment[:4]}-{moment[4:6]}-{moment[6:8]}T{moment[8:10]}:{moment[10:12]}:{moment[12:14]}Z"
    head, payload = _split_http(record.block)
    digest = base32_sha1(payload)
    key = _http_value(head, _KEY) if head else None
    if key and re.fullmatch(r"-?[0-9]+", key):
        identifier = key_urn(int(key))
    else:
        h = hashlib.sha1(f"{url} {date} {digest}".encode()).hexdigest()
        identifier = f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}>"
    if url.startswith("filedesc:"):
        kind, content_type = "warcinfo", "application/warc-fields"
    elif head:
        kind, content_type = "response", "application/http; msgtype=response"
    else:
        kind, content_type = ("response", "text/dns") if url.startswith("dns:") else ("resource", f["Content-type"])
    block = record.block
    lines = [f"WARC-Record-ID: {identifier}", f"WARC-Date: {date}"]
    if kind == "warcinfo":
        block = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
        lines.append(f"WARC-Filename: {url.removeprefix('filedesc://')}")
    else:
        lines += [f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
        if f["IP-address"] != "0.0.0.0":
            lines.append(f"WARC-IP-Address: {f['IP-address']}")
        if revisit_of:
            kind, block = "revisit", head
            lines += [f"WARC-Refers-To: {revisit_of}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += [f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n".encode() + "\r\n".join(lines).encode() + END + block


def parse_warc(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive that comes in pieces."""
    buffer, over = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal over
        while len(buffer) < n and not over:
            piece = next(pieces, None)
            if piece is None:
                over = True
            else:
                buffer.extend(piece)
        return len(buffer) >= n

    while True:
        while fill(1) and buffer[:1] in (b"\r", b"\n"):
            del buffer[: len(buffer) - len(buffer.lstrip(b"\r\n"))]
        if not buffer:
            return
        at = buffer.find(END)
        while at < 0 and fill(len(buffer) + 1):
            at = buffer.find(END)
        if at < 0 or not buffer.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in buffer[:at].decode().split("\r\n")[1:]))
        length = int(head["content-length"])
        if not fill(at + 4 + length):
            raise ValueError(f"record {head.get('warc-record-id')} ends early")
        yield head, bytes(buffer[at + 4 : at + 4 + length])
        del buffer[: at + 4 + length]


def _gunzip(data: bytes, piece: int = 1 << 20) -> Iterator[bytes]:
    """gzip members one after the other, a piece at a time."""
    while data:
        z = zlib.decompressobj(31)
        rest = data
        while rest and not z.eof:
            out = z.decompress(rest, piece)
            rest = z.unconsumed_tail
            if out:
                yield out
            elif not rest:
                break
        tail = z.flush()
        if tail:
            yield tail
        data = z.unused_data if z.eof else b""


_BAD_URL = re.compile(r"[\x00-\x20\x7f-\xa0]")


def page_block(page_id: int | None, html: bytes) -> bytes:
    key = b"" if page_id is None else _KEY + b" %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + key + b"Content-Length: %d" % len(html) + END + html


def _convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    start = datetime.datetime(2000, 1, 1)
    opened = False
    for batch in batches:
        out, size = [], 0
        for page_id, url, html, revisit_of in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), batch.column("revisit_of").to_pylist()):
            key = page_id or 0
            version = 1 + key % 2
            date = arc_date(start + datetime.timedelta(seconds=key % 10**8))
            raw = html.as_buffer().to_pybytes() if html.is_valid else b""
            url = _BAD_URL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or "-"
            arc = arc_file_header(version, "pages.arc", date) + arc_record(version, url, date, page_block(page_id, raw))
            info, record = parse_arc(arc)
            if not opened:
                out.append(arc_to_warc(info))
                opened = True
            out.append(arc_to_warc(record, None if revisit_of is None else key_urn(revisit_of)))
            size += len(out[-1])
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_ok", pa.bool_())])
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            raw = content.as_buffer().to_pybytes()
            for head, block in parse_warc(_gunzip(raw) if raw[:2] == b"\x1f\x8b" else iter([raw])):
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                http, payload = _split_http(block)
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(payload)
                size = len(payload)
                if kind == "revisit":
                    size = int(_http_value(http, b"Content-Length:") or 0)
                refers = head.get("warc-refers-to")
                rows.append((urn_key(head["warc-record-id"]) if _http_value(http, _KEY) else None, head.get("warc-target-uri"), head["warc-date"], head["warc-record-id"], size, digest,
                             kind, urn_key(refers) if refers else None, kind == "revisit" or base32_sha1(payload) == digest))
                if len(rows) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def shared_payloads(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """sha1 (hex) and response (page_id) of the payloads that several pages have."""
    html = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.sha1(F.encode(html, "utf-8")).alias("sha1"), F.octet_length(html).alias("size"), F.col("page_id").cast("long").alias("page_id"))
    return keyed.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 AND response IS NOT NULL").drop("n")


def pages_to_warc(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, broadcast_bytes: int = BROADCAST_BYTES, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``."""
    found = saved(shared_payloads(pages, least_bytes), "payloads")
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    records_per_file = max(1, min(records_per_file, int(file_bytes / (500 + mean))))
    small = found.count() * 64 <= broadcast_bytes
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    rows = rows.withColumn("sha1", F.sha1(F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")))
    rows = rows.join(F.broadcast(found) if small else found, "sha1", "left")
    revisit_of = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    rows = rows.select("page_id", "url", "html", revisit_of.alias("revisit_of"))
    records = rows.mapInArrow(_convert, "record binary").select(F.col("record").cast("string").alias("value"))
    writer = records.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
    writer.text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """READ: a row for each record of the WARC files (gzip or plain) under ``path``, warcinfo left out."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, READ)


def convert_arc_files(spark: SparkSession, path: str, out: str) -> None:
    """Convert the ARC files (gzip or plain) under ``path`` to WARC files under ``out``."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer().to_pybytes()
                raw = b"".join(_gunzip(raw)) if raw[:2] == b"\x1f\x8b" else raw
                for record in parse_arc(raw):
                    yield pa.RecordBatch.from_arrays([pa.array([arc_to_warc(record)], pa.binary())], ["record"])

    files = spark.read.format("binaryFile").load(path).select("content")
    files.mapInArrow(convert, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", END.decode()).option("compression", "gzip").text(out)


def archived(pages: DataFrame) -> DataFrame:
    """READ of the archives that ``pages`` are written to, in the shared folder."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    pages_to_warc(pages, path)
    return read_warc(spark, path)
