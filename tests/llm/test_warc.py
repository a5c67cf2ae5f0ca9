"""WARC archives: round trips, revisits, damaged archives."""

import glob
import gzip
import hashlib
import io
import os

import pytest

from metaloom.llm import warc_archive as W

LONG = "<p>" + "many words here " * 200


def pages(spark, rows, schema="page_id long, url string, html string, size int, digest string, key int"):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], schema)


def expected(rows, least=W.LEAST_BYTES):
    groups = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= least:
            groups.setdefault(b, []).append(-1 if i is None else i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        head = max(groups.get(b, [-1]))
        head = None if head == -1 else head
        revisit = b in groups and len(groups[b]) > 1 and head != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a.com/x", LONG), (9, "http://a.com/y\r\nX: 1", LONG), (4, None, LONG), (9, "http://a.com/y", LONG), (5, "u", "short"), (6, "u", "short"),
    (7, "", None), (8, "ü", ""), (None, "n", LONG), (10, "h", "x" * 999), (11, "h", "x" * 999), (12, "h", "x" * 1000), (13, "h", "x" * 1000),
    (14, "h", "\r\n\r\nWARC/1.1\r\n\r\n" * 300 + "\x1f\u008b\b"), (15, "big", "abé " * 300_000),
]


def test_round_trip(spark):
    got = W.archive_pages(pages(spark, ROWS)).collect()
    assert sorted([tuple(x)[:5] for x in got], key=str) == expected(ROWS)


def test_hot_payload_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(W.joins, "HOT_ROWS", 5)
    rows = [(i, "u", LONG if i % 3 else LONG + "2") for i in range(60)] + [(100, "u", None)]
    assert sorted([tuple(x)[:5] for x in W.archive_pages(pages(spark, rows)).collect()], key=str) == expected(rows)


def test_ids_of_other_types_and_empty_tables(spark):
    rows = [("a b/é>", "u", LONG), ("z", "u", LONG), ("", "u", "")]
    got = W.archive_pages(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()
    assert {(x.page_id, x.refers_to) for x in got} == {("a b/é>", "z"), ("z", None), ("", None)}
    none = W.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert none.count() == 0 and none.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_are_gzip_members_of_bounded_size(spark, tmp_path):
    listed = W.write_archives(pages(spark, ROWS).repartition(2), f"file://{tmp_path}/w", archive_bytes=1000).collect()
    files = sorted(glob.glob(f"{tmp_path}/w/*.warc.gz"))
    assert sorted(x.archive for x in listed) == [f"file://{f}" for f in files] and len(files) > 2
    assert sum(x.records for x in listed) == len(ROWS) and all(x.n_bytes == os.path.getsize(x.archive[7:]) for x in listed)
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC-Type: response\r\n") + text.count(b"WARC-Type: revisit\r\n") == len(ROWS)
    for f in files:
        for x in W.Reader(open(f, "rb"), chunk=100):
            raw = open(f, "rb").read()[x.offset :]
            assert raw.startswith(W.MAGIC) and x.problem is None


def archive(n=5):
    parts = [W.page_record(str(i), f"http://h/{i}", b"<p>%d " % i * (50 * i + 1), len(b"<p>%d " % i * (50 * i + 1)), hashlib.sha1(b"<p>%d " % i * (50 * i + 1)).hexdigest(), None) for i in range(n)]
    return parts, b"".join(parts)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_reader_takes_any_chunk(chunk):
    parts, whole = archive()
    got = list(W.Reader(io.BytesIO(whole), chunk))
    assert [x.offset for x in got] == [sum(map(len, parts[:k])) for k in range(5)]
    assert [x.payload_bytes for x in got] == [int(x.http["content-length"]) for x in got] and not any(x.problem for x in got)


def test_damaged_records_become_rows():
    parts, whole = archive()
    broken = bytearray(whole)
    broken[len(parts[0]) + len(parts[1]) // 2] ^= 0xFF
    got = list(W.Reader(io.BytesIO(bytes(broken)), 64))
    assert [x.problem is None for x in got] == [True, False, True, True, True]
    got = list(W.Reader(io.BytesIO(whole[:-10]), 64))
    assert [x.problem for x in got] == [None] * 4 + ["the archive ends inside a record"]
    wrong = W.page_record("1", "u", b"abc", 3, hashlib.sha1(b"abd").hexdigest(), None)
    short = W.member([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], b"abc")
    longer = gzip.compress(gzip.decompress(short).replace(b"Content-Length: 3", b"Content-Length: 9"))
    less = gzip.compress(gzip.decompress(short).replace(b"Content-Length: 3", b"Content-Length: 1"))
    got = [x.problem for x in W.Reader(io.BytesIO(wrong + b"junk" + longer + less + parts[1]), 64)]
    assert got == ["the payload doesn't have its digest", "not a gzip member", "the block is shorter than Content-Length", "the block is longer than Content-Length", None]
