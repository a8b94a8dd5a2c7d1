"""Web archives: legacy ARC files read, converted to WARC, and WARC files read back.

An ARC file starts with a version block whose second line names the version and whose third line
names the fields of every header line: five of them in version 1, ten in version 2. A header line
ends in the declared length of the document behind it; documents are cut by that length alone, so
a text that looks like a header does no harm. Header lines are split from the right, because old
archives hold addresses with blanks.

The conversion makes an equivalent WARC record of every document: an identifier that follows from
the archive's name and the place of the record, the date in ISO form, the type (warcinfo for the
version block, response for HTTP messages, resource for the rest), and digests of block and
payload. Of the records whose payloads are equal (SHA-256 and length) the one with the smallest key
stays a response; the others become revisits that refer to it and carry only their HTTP header.
Payloads below ``revisit_from`` bytes are never revisited.

Scale: an archive is one file of about ``archive_bytes`` (one record more at most), gzipped record by
record, and one task holds one archive. Payloads never travel to find equal ones: only keys and
digests are grouped, and the verdicts go to their archives, whose compressed files are the one thing
that is shuffled (or nothing, when the verdicts are small enough to be broadcast by the planner).
Files are written by Spark's own writer to the shared folder, so a lost executor costs a retry.

Defined results: a null html is an empty payload; null keys come after all others and refer as null;
repeated rows are separate records, equal ones differ by their place; a null or blank address is written as
``-``. A document that ends before its declared length is kept with what is there and marked truncated;
behind a header line that cannot be read nothing of that gzip member is read. Other columns of the pages
are ignored whatever their name; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import kept, raw, record_batch, table

#: Fixed values of the two formats: names of the fields of a header line, by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:arc-record")
CRAWL_DATE = "20240101000000"
KEY_HEADER = "X-Page-Key"
LEVEL, STEP = 3, 8192


@dataclass
class Document:
    """A document of an archive: fields of its header line and its bytes."""
    url: str
    ip: str
    date: str
    kind: str
    block: bytes
    at: int
    archive: str
    truncated: bool = False


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of a file one by one; a file that is not gzipped is one member."""
    if not content.startswith(b"\x1f\x8b"):
        yield content
        return
    view, pos = memoryview(content), 0
    while view[pos:pos + 2] == b"\x1f\x8b":
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof and pos < len(view):  # in steps: what is left over is copied
            step = view[pos:pos + STEP]
            parts.append(reader.decompress(step))
            pos += len(step)
        pos -= len(reader.unused_data)
        yield b"".join(parts)


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def iso_date(stamp: str) -> str:
    """An ARC date of up to 14 digits, short ones filled up, as ISO 8601."""
    digits = re.sub(r"\D", "", stamp)[:14]
    full = digits + "00000101000000"[len(digits):]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


def http_payload(block: bytes) -> tuple[dict[str, str], bytes, bytes] | None:
    """Header fields, header bytes and payload of an HTTP message; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    cut = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if cut < 0 else (block[:cut + 4], block[cut + 4:])
    return header_fields(head.split(b"\r\n")[1:]), head, payload


def header_fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            found[name.strip().lower()] = value.strip()
    return found


# ---------------------------------------------------------------------------- ARC

def arc_document(version: int, page: dict, archive: str, offset: int) -> bytes:
    """Header line and HTTP message of a page."""
    payload = page["html"] or b""
    key = "" if page["key"] is None else f"{KEY_HEADER}: {page['key']}\r\n"
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{key}"
             f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (page["url"] or "").strip()) or "-"
    fields = [url, "0.0.0.0", page["date"] or CRAWL_DATE, "text/html"]
    if version == 2:
        fields += ["200", sha1_base32(payload), "-", str(offset), archive]
    return f"{' '.join(fields)} {len(block)}\n".encode() + block + b"\n"


def arc_version_block(version: int, archive: str) -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{archive}", "0.0.0.0", CRAWL_DATE, "text/plain"]
    if version == 2:
        fields += ["200", "-", "-", "0", archive]
    return f"{' '.join(fields)} {len(body)}\n".encode() + body + b"\n"


def arc_documents(content: bytes) -> Iterator[Document]:
    """Documents of an ARC file, the version block first."""
    names, archive, at = [], "-", 0
    for data in members(content):
        pos = 0
        while pos < len(data):
            if data[pos:pos + 1] in (b"\n", b"\r", b"\0"):  # between documents, padding at the end
                pos += 1
                continue
            end = data.find(b"\n", pos)
            line = data[pos:end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
            # the version block says how many fields follow; its own line has those of its version
            width = len(names) or (10 if len(line.split(" ")) >= 10 else 5)
            fields = line.rsplit(" ", width - 1)
            if end < 0 or len(fields) != width or not fields[-1].isdecimal():
                break
            size = int(fields[-1])
            block = data[end + 1:end + 1 + size]
            if not names and fields[0].startswith("filedesc:"):
                archive = fields[0].partition("://")[2]
                told = block.decode("utf-8", "replace").split("\n")
                names = told[1].split(" ") if len(told) > 1 else []
            if not names:
                break
            named = dict(zip((n.lower() for n in names), fields)) if len(names) == width else {}
            yield Document(fields[0], named.get("ip-address", fields[1]), named.get("archive-date", fields[2]),
                           named.get("content-type", fields[3]), block, at + pos, archive, len(block) < size)
            pos = end + 1 + size
        at += len(data)


# ---------------------------------------------------------------------------- WARC

def record_id(document: Document) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{document.archive} {document.at}')}"


def warc_type(document: Document) -> str:
    if document.url.startswith("filedesc:"):
        return "warcinfo"
    return "response" if document.block.startswith(b"HTTP/") else "resource"


def warc_record(document: Document, refers_to: tuple[str, str, str] | None = None) -> bytes:
    """The record of a document; ``refers_to`` is id, address and date of what it repeats."""
    kind, block = warc_type(document), document.block
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(document)}>",
            "WARC-Date": iso_date(document.date)}
    if kind == "warcinfo":
        block = f"software: arc-conversion\r\nformat: WARC File Format 1.1\r\nisPartOf: {document.archive}\r\n".encode()
        head.update({"WARC-Filename": document.archive, "Content-Type": "application/warc-fields"})
    else:
        message = http_payload(block)
        payload = message[2] if message else block
        head.update({"WARC-Target-URI": document.url, "WARC-IP-Address": document.ip,
                     "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
                     "Content-Type": "application/http; msgtype=response" if message else document.kind})
        if document.truncated:
            head["WARC-Truncated"] = "length"
        if refers_to:
            block = message[1] if message else b""
            head.update({"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE,
                         "WARC-Refers-To": f"<{refers_to[0]}>", "WARC-Refers-To-Target-URI": refers_to[1],
                         "WARC-Refers-To-Date": refers_to[2]})
    head["WARC-Block-Digest"] = f"sha1:{sha1_base32(block)}"
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return WARC_VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record, cut by the declared length."""
    for data in members(content):
        pos = 0
        while data.startswith(b"WARC/", pos):
            cut = data.find(b"\r\n\r\n", pos)
            if cut < 0:
                break
            head = header_fields(data[pos:cut].split(b"\r\n")[1:])
            size = int(head["content-length"])
            yield head, data[cut + 4:cut + 4 + size]
            pos = cut + 4 + size + 4


# ---------------------------------------------------------------------------- Spark

def _write_files(blobs: DataFrame, path: str) -> str:
    """One file for every row of ``content`` (binary); the byte 0 that ends a file is padding."""
    blobs.select(F.col("content").cast("string")).write.option("lineSep", "\u0000") \
        .option("maxRecordsPerFile", 1).text(path)
    return path


def _read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


_CONTENT = pa.schema([("content", pa.binary())])


def _files(records: Iterator[bytes], opening, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Gather gzip members into files of about ``archive_bytes``; ``opening(k)`` starts file ``k``."""
    parts, size, number = [], 0, 0
    for make in records:
        if not parts:
            parts = [member(opening(number))] if opening else []
        parts.append(member(make(number, size)))
        size += len(parts[-1])
        if size >= archive_bytes:
            yield record_batch({"content": [b"".join(parts)]}, _CONTENT)
            parts, size, number = [], 0, number + 1
    if parts:
        yield record_batch({"content": [b"".join(parts)]}, _CONTENT)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2),
              archive_bytes: int = 16 << 20) -> str:
    """Write ``page_id, url, html`` as legacy archives, of the given versions in turn."""
    rows = pages.select(F.col("page_id").alias("key"), F.col("url"), raw("html").alias("html"))

    def run(batches):
        part = TaskContext.get().partitionId()
        name = lambda k: f"pages-{part:06d}-{k:06d}.arc.gz"
        version = lambda k: versions[(part + k) % len(versions)]

        def documents():
            for batch in batches:
                for at in range(batch.num_rows):
                    page = {c: batch.column(c)[at].as_py() for c in ("key", "url", "html")} | {"date": None}
                    yield lambda k, offset, page=page: arc_document(version(k), page, name(k), offset)

        yield from _files(documents(), lambda k: arc_version_block(version(k), name(k)), archive_bytes)

    return _write_files(rows.mapInArrow(run, "content binary"), path)


def _page_key(document: Document, message) -> str | None:
    return message[0].get(KEY_HEADER.lower()) if message else None


def _per_file(files: DataFrame, read, schema: str, rows_per_batch: int = 2000) -> DataFrame:
    """Rows that ``read(path, content)`` yields for every file."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = read(path, content.as_py())
                while out := list(islice(rows, rows_per_batch)):
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW[schema])

    return files.mapInArrow(run, schema)


_FOUND = "path string, at bigint, key bigint, digest binary, size bigint, id string, uri string, date string"
_READ = "id string, key bigint, size bigint, digest string, kind string, refers string, sound boolean"
_ARROW = {
    _FOUND: pa.schema([("path", pa.string()), ("at", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()),
                       ("size", pa.int64()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string())]),
    _READ: pa.schema([("id", pa.string()), ("key", pa.int64()), ("size", pa.int64()), ("digest", pa.string()),
                      ("kind", pa.string()), ("refers", pa.string()), ("sound", pa.bool_())]),
}


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def revisits(arcs: DataFrame, revisit_from: int = 0) -> DataFrame:
    """``path, at`` of every document that repeats another one's payload, with that one's id,
    address and date."""
    def read(path, content):
        for document in arc_documents(content):
            message = http_payload(document.block)
            if message and len(message[2]) >= revisit_from:
                yield {"path": path, "at": document.at, "key": _number(_page_key(document, message)),
                       "digest": hashlib.sha256(message[2]).digest(), "size": len(message[2]),
                       "id": record_id(document), "uri": document.url, "date": iso_date(document.date)}

    found = kept(_per_file(arcs, read, _FOUND), "documents")
    order = F.struct(F.col("key").isNull().alias("unknown"), "key", "id", "uri", "date")
    first = kept(found.groupBy("digest", "size").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
                 .where("n > 1").select("digest", "size", "first"), "first")
    return found.join(first, ["digest", "size"]).where("id <> first.id") \
        .select("path", "at", "first.id", "first.uri", "first.date")


def convert(spark: SparkSession, arc_path: str, warc_path: str, revisit_from: int = 0) -> str:
    """Write the WARC file of every ARC file."""
    arcs = _read_files(spark, arc_path)
    verdicts = kept(revisits(arcs, revisit_from).groupBy("path").agg(
        F.collect_list(F.struct("at", "id", "uri", "date")).alias("repeats")), "verdicts")

    def run(batches):
        for batch in batches:
            for content, repeats in zip(batch.column("content"), batch.column("repeats")):
                refers = {r["at"]: (r["id"], r["uri"], r["date"]) for r in repeats.as_py() or []}
                parts = [member(warc_record(document, refers.get(document.at)))
                         for document in arc_documents(content.as_py())]
                yield record_batch({"content": [b"".join(parts)]}, _CONTENT)

    return _write_files(arcs.join(verdicts, "path", "left").select("content", "repeats")
                        .mapInArrow(run, "content binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``id, key, size, digest, kind, refers, sound`` of the response and revisit records. The
    digest is that of the full payload; the size of a revisit is known by what it refers to."""
    def read(_, content):
        for head, block in warc_records(content):
            if head["warc-type"] not in ("response", "revisit"):
                continue
            message = http_payload(block)
            declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
            whole = head["warc-type"] == "response"
            digest = sha1_base32(message[2]) if whole and message else declared
            size = len(message[2]) if whole and message else None
            yield {"id": head["warc-record-id"].strip("<>"), "key": _number(_page_key(None, message)),
                   "size": size, "digest": digest, "kind": head["warc-type"],
                   "refers": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
                   "sound": digest == declared and head["warc-block-digest"] == f"sha1:{sha1_base32(block)}"}

    return _per_file(_read_files(spark, path), read, _READ)


def through_archives(pages: DataFrame, revisit_from: int = 0, versions: tuple[int, ...] = (1, 2),
                     archive_bytes: int = 16 << 20) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, sound``."""
    spark = pages.sparkSession
    arcs = write_arc(pages, scratch_path(spark, "arc"), versions, archive_bytes)
    records = kept(read_warc(spark, convert(spark, arcs, scratch_path(spark, "warc"), revisit_from)), "records")
    again = records.where("refers IS NOT NULL")
    origin = records.select(F.col("id").alias("of"), F.col("key").alias("refers_to"),
                            F.col("size").alias("full")).join(again.select("refers").distinct(),
                                                              F.col("of") == F.col("refers"), "left_semi")
    whole = again.join(origin, F.col("refers") == F.col("of"), "left").withColumn("size", F.col("full"))
    alone = records.where("refers IS NULL").withColumn("refers_to", F.lit(None).cast("bigint"))
    return alone.unionByName(whole.select(alone.columns)).select(
        F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to", "sound")


def op12_warc(spark, sf_dir):
    return through_archives(table(spark, sf_dir, "pages")).drop("sound")


OP12_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
ranked AS (
  SELECT *, row_number() OVER w AS rn, first_value(page_id) OVER w AS lead_id
  FROM p WINDOW w AS (PARTITION BY body ORDER BY page_id NULLS LAST))
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '')
         AS payload_digest,
       CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rn > 1 THEN lead_id END AS refers_to
FROM ranked
"""
