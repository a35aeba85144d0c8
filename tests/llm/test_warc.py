"""Round trips through archives, with payloads that hold whole records of their own."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from sievework.llm import warc
from sievework.llm.shared import Scratch

FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nWARC-Target-URI: x\r\nWARC-Payload-Digest: sha256:0\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
ROWS = [(i, f"u{i}", "x" * i * 7 + FAKE * (i % 3) + "é" * i) for i in range(50)] + [(100, None, None), (101, "u\r\nv", "same" * 40), (102, "u", "same" * 40), (102, "u", "same" * 40), (103, "u", "short"), (104, "u", "short"), (None, "u", "null id" * 40)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))


@pytest.mark.parametrize("range_bytes", [64, 700, 1 << 20])
@pytest.mark.parametrize("files", [1, 5])
def test_round_trip(spark, pages, range_bytes, files):
    scratch = Scratch(spark, "test-warc")
    path = scratch.path()
    warc.write(warc.records(pages.repartition(files), scratch), path)
    got = warc.read(spark, path, scratch, range_bytes).collect()
    assert len(got) == len(ROWS) and all(r.payload_digest == r.stored_digest for r in got)
    assert not [r for r in got if r.page_id == 99]
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert sorted((r.record_type, r.refers_to) for r in by[102]) == [("revisit", 101)] * 2 and by[101][0].record_type == "response"
    assert {r.record_type for r in by[103] + by[104]} == {"response"}
    for i, _, html in ROWS:
        body = (html or "").encode()
        for r in by[i]:
            assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
            assert r.record_type == "revisit" or r.payload == (html or "")


def test_broken_chains_end(spark, tmp_path):
    """Bytes behind a record that is no record are not reached, though they look like one."""
    good = FAKE.replace("page:99", "page:1")
    (tmp_path / "a.warc").write_bytes((good + "garbage" + good.replace("page:1", "page:2")).encode())
    (tmp_path / "b.warc").write_bytes(b"xx" + good.encode())
    got = warc.read(spark, f"file://{tmp_path}", Scratch(spark, "test-broken"), 100).collect()
    assert [r.page_id for r in got] == [1]


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_long_headers(spark):
    """A url longer than any buffer is part of its header, and the pages behind it are found."""
    rows = [(k, "data:," + "x" * n, f"page {k}") for k, n in enumerate([3, 1000, 70_000, 300_000, 5])]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(k, 6) for k in range(5)]


def test_broken_chains_raise_if_asked(spark, tmp_path):
    good = FAKE.replace("page:99", "page:1")
    (tmp_path / "a.warc").write_bytes((good + "garbage" + good).encode())
    with pytest.raises(Exception, match="the record chain ends"):
        warc.read(spark, f"file://{tmp_path}", Scratch(spark, "test-raise"), 100, whole_files=True).collect()


def test_magic_upon_magic(spark, monkeypatch):
    """Payloads full of the record magic, at the ends of lines that look like header lines too, are read in linear time."""
    magic = "WARC/1.0\r\n"
    texts = [magic * 100_000, ("A: " + magic) * 80_000, ("A: " + magic) * 50_000 + "Content-Length: 3\r\n\r\n", magic + "A" * 1_000_000, magic + "Content-Length: " + "9" * 5000 + "\r\n\r\n", (magic + "Content-Length: 0000000000000000000000000000002\r\n\r\n") * 3]
    df = spark.createDataFrame([(k, " url with ends ", t) for k, t in enumerate(texts)], "page_id long, url string, html string").coalesce(1)
    began = time.time()
    got = {r.page_id: r.payload_digest for r in warc.round_trip(df).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(texts)}
    assert time.time() - began < 30
    assert warc._length(b"0" * 5000 + b"12") == 12 and warc._length(b"0") == 0 and warc._length(b"9" * 5000) is None and warc._length(b"") is None
