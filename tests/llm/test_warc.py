"""The archive's round trip and the revisit rule."""
import hashlib

import pytest

from riskloom.llm import warc
from riskloom.llm.common import scratch_path
from tests.conftest import SF_SMALL

LONG = "x" * 99 + "é\r\n\r\nWARC/1.1\r\n"


def plain(pages):
    """(page_id, html) -> page_id -> the contract's row."""
    first = {}
    for i, html in pages:
        p = (html or "").encode()
        if len(p) >= warc.MIN_REVISIT:
            first[p] = min(first.get(p, i), i)
    out = {}
    for i, html in pages:
        p = (html or "").encode()
        kind = "revisit" if first.get(p, i) != i else "response"
        out[i] = (len(p), hashlib.sha256(p).hexdigest(), kind, first[p] if kind == "revisit" else None)
    return out


def got(frame):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()}


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame([
        (3, "http://a/", LONG, "h"), (1, "http://b/\r\nX-Page-ID: 9", LONG, "h"), (2, None, LONG, None),
        (4, "http://c/", None, "p"), (5, "http://c/", "", "p"), (6, "http://d/", "short", "p"), (7, "http://e/", "short", "p"),
        (8, "http://f/", "日本" * 50_000, "p"), (9, "http://g/", "a\r\n\r\nb" * 40 + "\r\n\r\n", "p"),
    ], "page_id bigint, url string, html string, payload string")


def test_query_equals_the_rule(spark):
    from riskloom.llm.queries import QUERIES
    pages = [(p.page_id, p.html) for p in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()]
    assert got(QUERIES["op4_warc"](spark, SF_SMALL)) == plain(pages)


def test_odd_pages_round_trip(spark, odd_pages, tmp_path):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(odd_pages, path)
    pages = {r.page_id: r.html or "" for r in odd_pages.collect()}
    rebuilt = warc.records(spark, path).collect()
    assert {r.page_id: bytes(r.payload) for r in rebuilt} == {i: t.encode() for i, t in pages.items()}
    stored = warc.payloads(spark, path)
    assert stored.count() == len(set(pages.values()))
    warc.export_warc(spark, path, f"{path}/files", file_records=2)
    found = warc.read_warc(spark, f"{path}/files")
    assert sorted(r.header for r in found.collect()) == sorted(r.header for r in rebuilt)
    assert got(warc.described(found, stored)) == plain(list(pages.items()))


def test_repeated_rows_and_nulls(spark, odd_pages):
    path = scratch_path(spark, "warc-test")
    extra = spark.createDataFrame([(None, "http://n/", LONG, "h"), (3, "http://a/", LONG, "h")], odd_pages.schema)
    warc.write_archive(odd_pages.union(extra), path)
    rows = warc.records(spark, path).collect()
    assert len(rows) == odd_pages.count() + 2
    kinds = sorted((r.page_id or 0, "Type: revisit" in r.header) for r in rows if "sha256:" + hashlib.sha256(LONG.encode()).hexdigest() in r.header)
    assert kinds == [(0, True), (1, False), (2, True), (3, True), (3, True)]


def test_empty_table(spark, odd_pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archive(odd_pages.limit(0), path)
    assert warc.records(spark, path).count() == 0
    warc.export_warc(spark, path, f"{path}/files")
    assert warc.read_warc(spark, f"{path}/files").count() == 0


def test_parser_rejects_a_torn_record():
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\nWARC/1.1\r\n\r\n"))
