import gzip
import hashlib
import io

import pytest

from tallywright.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, key string, refers_to string"


def pages(spark, *rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def found(frame):
    return {r.page_id: r.asDict() for r in warc.record_table(warc.archive_round_trip(frame)).collect()}


def test_equal_payloads_are_written_once(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c\r\nX: 1", big), (4, "d", "short"), (5, "e", "short")]
    rows += [(6, "f", None), (7, "g", "")]
    out = found(pages(spark, *rows))
    assert {k: (v["record_type"], v["refers_to"]) for k, v in out.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None),
        5: ("response", None), 6: ("response", None), 7: ("response", None),
    }
    for ident, _, html in rows:
        raw = (html or "").encode()
        assert (out[ident]["payload_bytes"], out[ident]["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())


def test_the_limit_for_revisits(spark):
    out = found(pages(spark, (1, "a", "x" * 999), (2, "b", "x" * 999), (3, "c", "y" * 1000), (4, "d", "y" * 1000)))
    assert [out[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "response", "revisit", "response"]


def test_rows_that_repeat_a_page_and_null_keys(spark):
    big = "z" * 2000
    rows = warc.record_table(warc.archive_round_trip(pages(spark, (1, "a", big), (1, "a", big), (None, "b", big)))).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows) == [
        (0, "revisit", 1), (1, "response", 0), (1, "response", 0),
    ]


def test_an_empty_table(spark):
    assert found(pages(spark).limit(0)) == {}


def test_chunks_carry_digests_so_far(spark, tmp_path):
    text = "0123456789" * 1000
    chunks = warc.to_chunks(warc.records(pages(spark, (1, "a", text), (2, "b", "t"))), chunk_bytes=999)
    manifest = warc.write_archives(chunks, f"file://{tmp_path}/warc", archive_bytes=1)
    out = warc.read_archives(manifest, chunk_bytes=700).orderBy("record_id", "chunk_no").collect()
    first = [r for r in out if r.record_id == "urn:page:1"]
    assert b"".join(bytes(r.data) for r in first) == text.encode() and len(first) == 15
    assert [r.is_last for r in first] == [False] * 14 + [True]
    for r in first:
        assert r.payload_digest == hashlib.sha1(text.encode()[: r.payload_bytes]).hexdigest()


def test_a_cut_archive_fails():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc"
    with gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(head))) as stream, pytest.raises(EOFError):
        list(warc.archive_chunks(stream, 10))
