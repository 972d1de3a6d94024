from __future__ import annotations

import gzip
import hashlib

import pytest

from curatrix.llm import warc as W
from curatrix.llm.common import fresh_path


def _archive(tmp_path, payloads):
    records = [W.encode_record(i, f"http://h/{i}?q=ü%20", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(records))
    return f"file://{path}", records


def test_every_cut_reads_each_record_once(tmp_path):
    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi", 0)
    uri, records = _archive(tmp_path, [b"a" * 300, b"", bytes(range(256)) * 4, b"\x1f\x8b\x08 not a member", inner * 3, b"end"])
    size = sum(map(len, records))
    for step in (1, 7, 64, 333, size):
        got = [int(f["x-page-id"]) for at in range(0, size, step) for f, _ in W.read_range(uri, at, min(at + step, size))]
        assert got == list(range(6)), step


def test_members_are_plain_gzip(tmp_path):
    uri, _ = _archive(tmp_path, [b"one", b"two"])
    text = gzip.decompress(open(uri[7:], "rb").read())
    assert text.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\none\r\n\r\n" in text


def test_round_trip_with_copies_nulls_and_ties(spark):
    big = "é" * 80
    rows = [(5, "http://a/", big), (2, None, big), (9, "u", "small"), (8, "u", "small"), (None, "v", big), (3, "w", None), (4, "x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS payload_digest", "1 AS refers_to")
    files = W.write_archives(pages, fresh_path(spark, "warc-test"))
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes): bytes(r.payload) if r.payload is not None else None for r in W.read_archives(spark, files, range_bytes=100).collect()}
    assert set(got) == {(5, "revisit", 2, 160), (2, "response", None, 160), (9, "response", None, 5), (8, "response", None, 5), (None, "revisit", 2, 160), (3, "response", None, 0), (4, "response", None, 0)}
    assert got[2, "response", None, 160].decode() == big and got[5, "revisit", 2, 160] is None


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    files = W.write_archives(pages, fresh_path(spark, "warc-test"))
    assert files == [] and W.read_archives(spark, files).collect() == []


def test_long_headers_lose_no_record(spark, tmp_path):
    """A header block of any length is found to its end, wherever a range starts."""
    urls = ["http://h/a", "http://h/" + "é" * 30_000, "http://h/b", "http://h/" + "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(6000)), "http://h/c"]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    files = W.write_archives(pages, fresh_path(spark, "warc-test"))
    assert sum(n for _, _, n in files) == len(rows)
    for step in (1000, 70_000, 1 << 23):
        got = W.read_archives(spark, files, range_bytes=step)
        assert sorted(r.page_id for r in got.collect()) == list(range(len(rows))), step
    assert W.all_read(got, files).count() == len(rows)
    with pytest.raises(ValueError, match="records read"):
        W.all_read(got.where("page_id > 0"), files)


def test_addresses_come_back_and_foreign_records_are_read(spark, tmp_path):
    import gzip

    urls = ["http://a/b%20c", "http://a/é ü", "http://a/" + "x" * 1_000_000, "http://a/%", "http://a/\r\nX-Page-Id: 7", None]
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)]
    files = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "own"))
    assert {r.page_id: r.url for r in W.read_archives(spark, files, range_bytes=900).collect()} == dict(enumerate(urls))

    def record(kind, content, block, *more):
        head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Target-URI: <http://x/%41>", *more, f"Content-Type: {content}", f"Content-Length: {len(block)}"]
        return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    data = record("warcinfo", "application/warc-fields", b"software: x\r\n") + record("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\n\r\nbody", "WARC-Payload-Digest: sha1:ABCDEF") + record("resource", "text/plain", b"plain\r\n\r\ntext")
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(data)
    for cut in (1, 7, 50, 10**6):
        got = W.read_archives(spark, [(f"file://{path}", len(data), 3)], range_bytes=cut).collect() if cut > 1 else [r for k in range(len(data)) for r in W.read_range(f"file://{path}", k, k + 1)]
        assert len(got) == 3
    by = {r.record_type: r for r in got}
    assert bytes(by["response"].payload) == b"body" and bytes(by["resource"].payload) == b"plain\r\n\r\ntext" and by["resource"].url == "http://x/%41"
    assert by["response"].payload_digest == hashlib.sha256(b"body").hexdigest()
