"""WARC archives: round trip through monolithic and normalised files."""

import gzip
import hashlib
import json
import zlib
from collections import Counter

import pytest
from conftest import SF001

from tabrisk.llm import warc
from tabrisk.session import scratch_path


@pytest.fixture(scope="module")
def pages(spark):
    long = "é<p>\r\n\r\nContent-Length: 5\r\n\r\nWARC/1.1" * 60
    rows = [(1, "http://a/1", long, 1), (5, "http://a/5\r\nX: y", long, None), (3, None, long, 3), (4, "u", "short", 4), (6, "u", "short", 4),
            (7, "u", None, 7), (8, "u", "", 8), (9, "u", "z" * 300_000, 9), (9, "u", "z" * 300_000, 9), (2, "u", "z" * 300_000, 2), (None, "u", long, 0), (None, None, "n" * 2000, 0), (10, "u", "x\0\x01￾", 1)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, offset int")


def want(rows):
    top = {}
    for k, t in rows:
        top[t or ""] = max([x for x in (top.get(t or ""), k) if x is not None], default=None)
    out = Counter()
    for k, t in rows:
        b = (t or "").encode()
        ref = top[t or ""] if len(b) >= 1000 and top[t or ""] != k else None
        out[(k, len(b), hashlib.sha1(b).hexdigest(), "response" if ref is None else "revisit", ref)] += 1
    return out


def test_round_trip(spark, pages):
    for df in (pages, spark.read.parquet(f"{SF001}/pages.parquet"), pages.limit(0)):
        rows = [(r["page_id"], r["html"]) for r in df.collect()]
        got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.op3(spark, df).collect())
        assert got == want(rows)


def test_files_are_members_with_index(spark, pages):
    raw, normal = scratch_path(spark, "t-raw"), scratch_path(spark, "t-warc")
    warc.write_monolithic(pages, raw)
    warc.normalise(spark, raw, normal)
    files = {(r["kind"], r["archive"]): bytes(r["content"]) for r in spark.read.format("binaryFile").load(normal).collect()}
    before = sorted(rec for r in spark.read.format("binaryFile").load(raw).collect() for rec in gzip.decompress(bytes(r["content"])).split(b"WARC/1.1\r\nWARC-Type"))
    after = []
    for (kind, name), data in files.items():
        if kind == "data":
            whole, entries = gzip.decompress(data), [json.loads(x) for x in gzip.decompress(files["index", name]).decode().split("\n")]
            parts = [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in entries]
            assert b"".join(parts) == whole and all(p.endswith(b"\r\n\r\n") for p in parts)
            after += whole.split(b"WARC/1.1\r\nWARC-Type")
    assert sorted(after) == before


def test_stream_errors():
    good = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 2)
    assert list(warc.split_stream(good)) == [b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc"] * 2
    assert len(list(warc.split_stream(good + good))) == 4
    assert list(warc.split_stream(gzip.compress(b""))) == []
    for bad in (good[:-9], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"), gzip.compress(b"WARC/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(warc.split_stream(bad))
