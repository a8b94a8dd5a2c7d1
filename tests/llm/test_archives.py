"""Archives: formats by hand, round trips, equal payloads against a plain scan."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from sunledger.llm import archives, queries
from tests.oracle import compare, duck

FOLDER = "/root/testdata/sf0.001"


def arc(*parts):
    return b"".join(line + str(len(block)).encode() + b"\n" + block + b"\n" for line, block in parts)


V1 = arc((b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain ", b"1 0 Some Archive\n"
          b"URL IP-address Archive-date Content-type Archive-length\n"),
         (b"http://a.example/with a blank 1.2.3.4 19961104142103 text/html ",
          b"HTTP/1.0 200 OK\r\nX: y\r\n\r\n<p>\r\n\r\nx</p>\n"),
         (b"dns:a.example 1.2.3.4 1997 text/dns ", b"1.2.3.4 \nx")) + (
    b"http://b.example/ 1.2.3.4 19970101000000 text/html 5000\nHTTP/1.0 200 OK\r\n\r\ncut")
V2 = arc((b"filedesc://two.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 two.arc ", b"2 0 Someone\n"
          b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename "
          b"Archive-length\n\n"),
         (b"http://c.example/ 1.2.3.4 20010203040506 text/html 200 abc - 205 two.arc ",
          b"HTTP/1.1 200 OK\r\n\r\nxyz"))


def test_header_lines_of_both_versions():
    one = list(archives.arc_documents(V1))
    assert [d.url for d in one] == ["filedesc://old.arc", "http://a.example/with a blank",
                                    "dns:a.example", "http://b.example/"]
    assert [archives.warc_type(d) for d in one] == ["warcinfo", "response", "resource", "response"]
    assert archives.http_payload(one[1].block)[2] == b"<p>\r\n\r\nx</p>\n"
    assert [d.truncated for d in one] == [False, False, False, True]
    assert [archives.iso_date(d.date) for d in one[1:3]] == ["1996-11-04T14:21:03Z", "1997-01-01T00:00:00Z"]
    two = list(archives.arc_documents(V2))
    assert [(d.url, d.date, d.archive) for d in two[1:]] == [("http://c.example/", "20010203040506", "two.arc")]
    assert archives.http_payload(two[1].block)[2] == b"xyz"
    packed = b"".join(map(gzip.compress, (V2[:V2.index(b"http://c")], V2[V2.index(b"http://c"):])))
    assert [d.block for d in archives.arc_documents(packed + b"\0")] == [d.block for d in two]
    assert list(archives.arc_documents(b"no archive\n")) == [] == list(archives.arc_documents(b""))


def test_warc_records_read_back_by_their_lengths():
    documents = list(archives.arc_documents(V1))
    content = b"".join(archives.member(archives.warc_record(d)) for d in documents) + b"\0"
    read = list(archives.warc_records(content))
    assert [h["warc-type"] for h, _ in read] == ["warcinfo", "response", "resource", "response"]
    assert [b for _, b in read[1:]] == [d.block for d in documents[1:]]
    assert read[3][0]["warc-truncated"] == "length" and read[1][0]["warc-date"] == "1996-11-04T14:21:03Z"
    assert len({h["warc-record-id"] for h, _ in read}) == 4
    assert read[1][0]["warc-record-id"] == f"<{archives.record_id(documents[1])}>"
    again = archives.warc_record(documents[1], ("urn:uuid:x", "http://o.example/", "2000-01-01T00:00:00Z"))
    (head, block), = archives.warc_records(again)
    assert head["warc-refers-to"] == "<urn:uuid:x>" and block.endswith(b"\r\n\r\n")
    assert head["warc-payload-digest"] == read[1][0]["warc-payload-digest"]


def wanted(rows, least=0):
    payload = [(html or "").encode() for _, _, html in rows]
    first = {}
    for (key, _, _), body in zip(rows, payload):
        if body not in first or first[body] is None or key is not None and key < first[body]:
            first[body] = key
    out, given = [], set()
    for (key, _, _), body in sorted(zip(rows, payload), key=lambda r: (r[0][0] is None, r[0][0] or 0)):
        own = len(body) < least or key == first[body] and body not in given
        given.add(body)
        out.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "response" if own else "revisit", None if own else first[body]))
    return sorted(map(repr, out))


@pytest.mark.parametrize("settings", [{}, {"archive_bytes": 500, "versions": (2,)}, {"archive_bytes": 1}])
def test_pages_through_archives(spark, settings):
    rng = random.Random(4)
    bodies = ["", None, "<p>é中</p>", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n",
              "http://x.example/ 0.0.0.0 20240101000000 text/html 3\nabc\n", "\n\n\0\r\n", "long " * 300_000,
              "filedesc://x 0.0.0.0 1 text/plain 9\n"]
    rows = [(i, rng.choice([None, " ", f"http://s.example/{i} é\n x"]), rng.choice(bodies)) for i in range(90)]
    rows += [rows[3], rows[3], (None, None, "alone"), (None, "u", "<p>é中</p>"), (-5, "u", ""), (None, None, "alone")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns(
        {c: F.lit("clash") for c in ("key", "path", "content", "digest", "id", "refers")})
    for least in (0, 5):
        got = archives.through_archives(frame.repartition(3), least, **settings)
        assert got.where("NOT sound").count() == 0
        assert sorted(repr(tuple(r)) for r in got.drop("sound").collect()) == wanted(rows, least)


def test_no_pages(spark):
    assert archives.through_archives(spark.createDataFrame(
        [], "page_id bigint, url string, html string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are absent")
def test_query_against_sql(spark):
    assert compare(queries.QUERIES["op12_warc"](spark, FOLDER), duck(FOLDER), queries.ORACLES["op12_warc"]) is None
