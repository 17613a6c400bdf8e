"""Legacy ARC archives to WARC: parsing by declared lengths, synthesised WARC headers, revisits, and reading back."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, text_buffers

#: The fields of an ARC URL record, by version of the file.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: When the pages were captured, where nothing says so; 14 digits as in ARC.
CAPTURED = "20200101000000"
#: Payload bytes that a task writes, on average, and most tasks; then tasks grow, and files end at MOST_FILE_BYTES.
FILE_BYTES, MOST_TASKS = 16 << 20, 8192
MOST_FILE_BYTES = 256 << 20
#: Bytes of a compressed archive that are read at a time.
READ_BYTES = 1 << 20
CRLF = b"\r\n"


def _word(text: str | None) -> str:
    """A header field without spaces or controls; "-" for nothing."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text or "") or "-"


def http_block(payload: bytes, page_id) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\nContent-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def arc_file(records, version: int, name: str = "pages.arc", date: str = CAPTURED) -> bytes:
    """An ARC file: the version block, then for each (url, block) its URL record and the block."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 Basalt\n{fields}\n".encode()
    tail = "200 - - 0 " + name if version == 2 else ""
    first = f"filedesc://{name} 0.0.0.0 {date} text/plain {tail + ' ' if tail else ''}{len(body)}\n".encode()
    out = [first, body, b"\n"]
    offset = sum(map(len, out))
    for url, block in records:
        middle = f"200 {_b32(block)} - {offset} {name} " if version == 2 else ""
        line = f"{_word(url)} 0.0.0.0 {date} text/html {middle}{len(block)}\n".encode()
        out += [line, block, b"\n"]
        offset += len(line) + len(block) + 1
    return b"".join(out)


def arc_records(data: bytes):
    """Yields (fields by name, offset, block) of each record; the first is the version block, as "filedesc://...".

    The version block says which fields a URL record has; a record's last field is the length of its block.
    Lines between records may be empty.  A header with another number of fields, a length that is no number and
    a block that ends early raise ValueError.
    """
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header without an end at byte {at}")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not parts[-1].isdigit():
            raise ValueError(f"ARC record without a length at byte {at}")
        block = data[end + 1 : end + 1 + int(parts[-1])]
        if len(block) < int(parts[-1]):
            raise ValueError(f"ARC record cut short at byte {at}")
        if names is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file starts with a version block")
            lines = block.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            names = (lines[1] if len(lines) > 1 and lines[1].strip() else ARC_FIELDS[version]).split()
            shown = dict(zip(("URL", "IP-address", "Archive-date", "Content-type"), parts[:4], strict=False))
            yield {**shown, "Archive-length": parts[-1]}, at, block
        elif len(parts) != len(names):
            raise ValueError(f"ARC record with {len(parts)} fields instead of {len(names)} at byte {at}")
        else:
            yield dict(zip(names, parts, strict=True)), at, block
        at = end + 1 + int(parts[-1])


def parse_arc(data: bytes):
    """Yields (fields by name, offset, block) of each record after the version block."""
    found = arc_records(data)
    next(found, None)
    yield from found


def warc_date(text: str | None) -> str | None:
    """An ARC date as WARC writes it, or None.

    An ARC date is a run of digits, from the year on: 14 to the second, 12 to the minute, down to 4 for the year alone.
    What is missing is the first month, day, hour, minute or second; digits after the fourteenth are left out.
    """
    digits = (text or "").strip()
    if not digits.isascii() or not digits.isdigit() or len(digits) < 4 or (len(digits) % 2 and len(digits) < 14):
        return None
    try:
        return datetime.strptime((digits + "00000101000000"[len(digits) :])[:14], "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


def _b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload); a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(CRLF + CRLF)
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


def record_id(url: str, date: str, digest: str, page_id) -> str:
    """The same capture always gets the same identifier."""
    seen = hashlib.sha1("\n".join(map(str, (url, date, digest, page_id))).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seen[:16], version=5)}>"


def _record(lines: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*lines, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF + block


def warc_record(fields: dict, block: bytes, original: tuple | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A WARC record of an ARC record, without the two line ends that follow a record.

    An HTTP message is a response; any other block (a DNS answer, an FTP file, a page without its headers) is a
    resource; the version block is the warcinfo.  A date that is none becomes ``date``, and the record keeps what
    stood there.  Result code, checksum and location of version 2 are kept too.

    ``original`` is (page_id, url) of the response that this capture repeats; the record is then a revisit and
    holds the HTTP headers alone, whose Content-Length still is the full payload's.
    """
    head, payload = split_http(block)
    digest, page_id = _b32(payload), http_field(head, "X-Page-Id") or ""
    url, stamp = fields["URL"], fields.get("Archive-date", "")
    when = warc_date(stamp)
    lines = [("WARC-Date", when or date), ("WARC-Record-ID", record_id(url, stamp, digest, page_id))]
    if url.startswith("filedesc://"):
        return _warcinfo(lines, url, block)
    kept = head if original else block
    kind = "revisit" if original else "response" if head else "resource"
    lines = [
        ("WARC-Type", kind), ("WARC-Target-URI", url), *lines, ("WARC-IP-Address", fields.get("IP-address", "0.0.0.0")),
        ("WARC-Payload-Digest", "sha1:" + digest), ("WARC-Block-Digest", "sha1:" + _b32(kept)),
        ("Content-Type", "application/http; msgtype=response" if head else fields.get("Content-type", "application/octet-stream")),
    ]
    if original:
        lines += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(_word(original[1]), stamp, digest, original[0])),
            ("WARC-Refers-To-Target-URI", _word(original[1])),
            ("X-Refers-To-Page-Id", str(original[0])),
        ]
    if when is None:
        lines.append(("X-Archive-Date", _word(stamp)))
    lines += [(f"X-Archive-{k}", fields[k]) for k in ("Result-code", "Checksum", "Location") if fields.get(k, "-") != "-"]
    return _record(lines, kept)


def _warcinfo(lines: list[tuple[str, str]], url: str, block: bytes) -> bytes:
    """The version block: its name, version, software and fields as application/warc-fields."""
    text = block.decode("utf-8", "replace").splitlines()
    version, _, software = (text[0] if text else "").partition(" ")
    said = [("software", software.removeprefix("0 ").strip() or "unknown"), ("format", "WARC File Format 1.0"), ("isPartOf", url.removeprefix("filedesc://"))]
    said += [("x-arc-version", version), ("x-arc-fields", text[1].strip() if len(text) > 1 else "")]
    body = "".join(f"{k}: {v}\r\n" for k, v in said).encode()
    name = url.removeprefix("filedesc://") or "-"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Filename", name), *lines, ("WARC-Block-Digest", "sha1:" + _b32(body)), ("Content-Type", "application/warc-fields")], body)


def parse_warc(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict, bytes]]:
    """Yields (headers, block) of each record, by declared lengths, of bytes or of chunks of them."""
    chunks = iter([data] if isinstance(data, bytes) else data)
    held, base, open_ = bytearray(), 0, True

    def fill(size: int | None, find_from: int = 0) -> int:
        """Reads on until so many bytes are held, or until a header has its end; returns where the header ends."""
        nonlocal open_
        while True:
            end = held.find(CRLF + CRLF, find_from) if size is None else (0 if len(held) >= size else -1)
            if end >= 0 or not open_:
                return end
            find_from = max(0, len(held) - 3)
            more = next(chunks, None)
            open_ = more is not None
            held.extend(more or b"")

    while True:
        fill(2)
        if held[:2] == CRLF:
            del held[:2]
            base += 2
            continue
        if not held:
            return
        end = fill(None)
        if not held.startswith(b"WARC/") or end < 0:
            raise ValueError(f"no WARC record at byte {base}")
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(headers["Content-Length"])
        if fill(stop) < 0:
            raise ValueError(f"WARC record cut short at byte {base}")
        yield headers, bytes(held[end + 4 : stop])
        del held[:stop]
        base += stop


def _captures(batch):
    """The ARC records of a batch of (page_id, url, html), each in an ARC file of version 1 or 2, in order of parsing.

    Yields (row, fields, block).
    """
    ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    data, offsets = text_buffers(batch.column(2))
    for version in (1, 2):
        rows = [r for r, i in enumerate(ids) if (i or 0) % 2 == version - 1]
        image = arc_file(((urls[r], http_block(data[offsets[r] : offsets[r + 1]].tobytes(), ids[r])) for r in rows), version)
        for r, (fields, _, block) in zip(rows, parse_arc(image), strict=True):
            yield r, fields, block


def _digests(batches):
    import pyarrow as pa

    from .common import slices

    for batch in slices(batches, 256):
        out: list[list] = [[], [], [], []]
        ids = batch.column(0).to_pylist()
        for r, _, block in _captures(batch):
            _, payload = split_http(block)
            for column, x in zip(out, (ids[r], hashlib.sha1(payload).hexdigest(), hashlib.sha256(payload).digest(), len(payload)), strict=True):
                column.append(x)
        types = (pa.int64(), pa.string(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["page_id", "sha1", "sha256", "n"])


def _records(batches):
    import pyarrow as pa

    from .common import slices

    for batch in slices(batches, 256):
        origin, where = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        out = [warc_record(fields, block, None if origin[r] is None else (origin[r], where[r])) for r, fields, block in _captures(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes WARC archives, gzip files of about FILE_BYTES, with one record for each page.

    Each batch of pages becomes an ARC file (version 1 for even ids, 2 for odd), which is parsed and converted.  Of pages with equal payloads, the one with the largest id
    is a response and the others revisit it; the largest id is found by payload digests alone, combined map-side.
    The records go through Spark's text writer with the end of a WARC record for a line end: the writer commits
    whole files, so a lost executor leaves no part of one.

    A null page has an empty payload.  Rows that repeat the largest id of a payload are all responses.  Rows with a
    null id revisit the largest id if there is one, else they are responses.  Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    seen = materialize(rows.mapInArrow(_digests, "page_id long, sha1 string, sha256 binary, n long"), "warc-digests")
    most = seen.groupBy("sha256").agg(F.max("page_id").alias("origin"), F.count("*").alias("copies"))
    most = most.where("copies > 1 and origin is not null").select("sha256", "origin")
    # The original's URL stands in the revisit; ids that repeat give their smallest URL.
    urls = rows.select(F.col("page_id").alias("origin"), F.col("url").alias("origin_url"))
    most = materialize(most.join(urls, "origin").groupBy("sha256", "origin").agg(F.min("origin_url").alias("origin_url")), "warc-origins")
    again = seen.join(most, "sha256").where(~F.col("page_id").eqNullSafe(F.col("origin")))
    again = materialize(again.select("page_id", "sha1", "origin", "origin_url").distinct(), "warc-revisits")
    size = seen.agg(F.sum("n").alias("bytes"), F.count("*").alias("n")).first()
    files = min(MOST_TASKS, max(1, math.ceil((size.bytes or 0) / FILE_BYTES)))
    each = max(1, int(MOST_FILE_BYTES * size.n / max(1, size.bytes or 0)))  # records in a file at their mean size
    # One key of id and payload on both sides, so that the pages are dealt once: to files, and to their revisits.
    key = lambda sha1: F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), sha1)
    dealt = rows.withColumn("k", key(F.sha1(F.col("html").cast("binary")))).repartition(files, "k")
    again = again.select(key(F.col("sha1")).alias("k"), "origin", "origin_url").repartition(files, "k")
    joined = dealt.join(again, "k", "left")
    records = joined.select("page_id", "url", "html", "origin", "origin_url").mapInArrow(_records, "record binary")
    _write(records, path, each)


def _write(records: DataFrame, path: str, each: int = 0) -> None:
    text = records.select(F.col("record").cast("string"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", each).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, target_uri, date, payload) of WARC archives.

    ``payload`` is null for a revisit; its length comes from the HTTP headers it keeps.  Of a resource the whole block is
    the payload; a warcinfo has no row.  An archive is inflated and parsed a record at a time.
    """

    def work(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            + [("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in parse_warc(_inflated(content.as_buffer())):
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    revisit = headers["WARC-Type"] == "revisit"
                    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
                    rows.append({
                        "page_id": number(http_field(head, "X-Page-Id")),
                        "payload_bytes": number(http_field(head, "Content-Length")) if revisit else len(payload),
                        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else _b32(payload),
                        "record_type": headers["WARC-Type"],
                        "refers_to": number(headers.get("X-Refers-To-Page-Id")),
                        "record_id": headers["WARC-Record-ID"],
                        "target_uri": headers.get("WARC-Target-URI"),
                        "date": headers["WARC-Date"],
                        "payload": None if revisit else payload,
                    })
                    held += len(block)
                    if len(rows) == 256 or held > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, target_uri string, date string, payload binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, out)


def _inflated(raw) -> Iterator[bytes]:
    """The content of a file, of all its members if it is gzip, in chunks."""
    view = memoryview(raw)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[at : at + READ_BYTES]) for at in range(0, len(view), READ_BYTES))
        return
    at, d = 0, zlib.decompressobj(31)
    while at < len(view):
        part = view[at : at + READ_BYTES]
        at += len(part)
        part = bytes(part)
        while part:
            yield d.decompress(part)
            part = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)


def convert_arc(spark: SparkSession, source: str, path: str) -> None:
    """ARC files, plain or gzip, to WARC archives: a warcinfo for each file, a response or resource for each record.

    A record whose date is none gets the file's, and if that is none either the first second of 1970.
    """

    def work(batches):
        import pyarrow as pa

        out, held = [], 0
        for batch in batches:
            for content in batch.column(0):
                date = None
                for fields, _, block in arc_records(b"".join(_inflated(content.as_buffer()))):
                    date = date or warc_date(fields["Archive-date"]) or "1970-01-01T00:00:00Z"
                    out.append(warc_record(fields, block, date=date))
                    held += len(block)
                    if held > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    _write(spark.read.format("binaryFile").load(source).select("content").mapInArrow(work, "record binary"), path)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the pages as WARC in the shared folder and reads the archives back.  An empty table gives an empty result."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    return read_warc(pages.sparkSession, path)
