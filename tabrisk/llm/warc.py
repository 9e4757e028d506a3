"""WARC archives: write, normalise to one gzip member per record with a sidecar offset index, and read back.

`write_monolithic` writes WARC/1.1 records through Spark's text writer, whose separator is the end of a WARC record and
whose compression makes every file one gzip stream. `normalise` reads such a file as a stream and inflates it once, piece
by piece, writes every record as a gzip member of its own, and writes a sidecar index with each member's offset and length
in the same job. `read_records` fetches the members by the index. All files are written by Spark's committers, so a task
that is lost is simply run again, and any Hadoop file system will do.

Spark's text writer puts a separator after every row. In a normalised archive it is an empty gzip member (20 bytes,
valid between members), and the offsets of the index account for it.

Defined results: a null page is an empty payload; a null url has no target header; a null page_id has the record id
<urn:page:null>. Of records with equal payloads of 1000 bytes or more those with the largest page_id are responses (rows
that repeat it too). An empty table gives no archive records.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.llm.common import materialize
from tabrisk.session import scratch_path

RECORD_END = "\r\n\r\n"
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
REVISIT_FROM = 1000  # bytes of payload
RECORDS_PER_FILE = 5000
STEP = 1 << 20  # bytes that are inflated at a time
DATE = "2000-01-01T00:00:00Z"


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, digest, n and refers_to (null for responses).

    Only digests and ids are shuffled to find equal payloads; what refers to another record is a table of its own.
    """
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("payload"))
    p = p.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    ids = p.filter(F.col("n") >= revisit_from).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("c")).filter("c > 1 AND refers_to IS NOT NULL")
    others = ids.join(first.drop("c"), "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    others = materialize(others, "warc-revisits").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "refers_to")
    on = p["page_id"].eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest"))
    return p.join(others, on, "left").select("page_id", "url", "payload", "digest", "n", "refers_to")


def record(planned: DataFrame) -> DataFrame:
    """One column: the whole WARC record as text, without the two line ends that close it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    url = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id")), F.lit(f"\r\nWARC-Date: {DATE}"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), url), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    return planned.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_monolithic(pages: DataFrame, path: str) -> None:
    """Write the records of `pages`; every file is one gzip stream of whole records."""
    rows = record(plan_records(pages))
    rows.write.option("compression", "gzip").option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def split_stream(gz: bytes) -> Iterator[bytes]:
    """The records of a gzip file, without their closing line ends; inflates the stream once, in steps."""
    inflate, kept = zlib.decompressobj(31), bytearray()
    view, at, need = memoryview(gz), 0, 0
    while True:
        while len(kept) >= max(need, 1):
            end = kept.find(b"\r\n\r\n")
            if end < 0:
                break
            size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", kept[:end])
            if size is None:
                raise ValueError("a WARC record without a length")
            need = end + 4 + int(size[1])
            if len(kept) < need + 4:
                need += 4
                break
            yield bytes(kept[:need])
            del kept[: need + 4]
            need = 0
        if inflate.eof:
            rest = inflate.unused_data + bytes(view[at:])
            if not rest.strip(b"\0"):
                break
            inflate, view, at = zlib.decompressobj(31), memoryview(rest), 0
        elif inflate.unconsumed_tail:
            kept += inflate.decompress(inflate.unconsumed_tail, STEP)
        elif at < len(view):
            kept += inflate.decompress(view[at : at + STEP], STEP)
            at += STEP
        else:
            raise ValueError("a gzip stream ends early")
    if kept:
        raise ValueError("a WARC file ends within a record")


def _member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def headers(rec: bytes) -> tuple[dict[str, str], int]:
    """The WARC headers of a record by lower-case name, and where its block begins."""
    end = rec.index(b"\r\n\r\n")
    lines = rec[:end].decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}, end + 4


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Rewrite every gzip WARC file below `source`.

    Writes `target`/kind=data/archive=NAME (members) and `target`/kind=index/archive=NAME (one gzip member with a JSON
    line of offset, length, type and id for each record).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, gz in zip(frame["path"], frame["content"], strict=True):
                name, offset, seq, lines, out, size = re.sub(r"[^A-Za-z0-9]+", "_", path.rsplit("/", 1)[-1]), 0, 0, [], [], 0
                for rec in split_stream(gz):
                    m, (h, _) = _member(rec + RECORD_END.encode()), headers(rec)
                    lines.append(json.dumps({"offset": offset, "length": len(m), "type": h["warc-type"], "id": h["warc-record-id"]}))
                    out.append(("data", name, seq, m))
                    offset, seq, size = offset + len(m) + len(EMPTY_MEMBER), seq + 1, size + len(m)
                    if size > 8 * STEP:
                        yield pd.DataFrame(out, columns=["kind", "archive", "seq", "value"])
                        out, size = [], 0
                out.append(("index", name, 0, _member("\n".join(lines).encode())))
                yield pd.DataFrame(out, columns=["kind", "archive", "seq", "value"])

    files = spark.read.format("binaryFile").load(source).select("path", "content")
    rows = files.mapInPandas(run, "kind string, archive string, seq long, value binary").sortWithinPartitions("kind", "archive", "seq")
    rows.select("kind", "archive", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "archive").option(
        "encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("compression", "none").text(target)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(archive, index): the sidecar of every archive, inflated, one JSON line per record."""
    inflated = F.udf(lambda b: zlib.decompressobj(31).decompress(b).decode(), "string")
    return spark.read.format("binaryFile").load(path).filter("kind = 'index'").select("archive", inflated("content").alias("index"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Per record of the normalised archives, fetched by its offset: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A response's payload is measured and digested and must agree with its header; a
    revisit has its headers only."""

    def page_of(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(found[1]) if found else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for gz, index in zip(frame["content"], frame["index"], strict=True):
                rows = []
                for entry in map(json.loads, index.split("\n") if index else []):
                    rec = zlib.decompress(gz[entry["offset"] : entry["offset"] + entry["length"]], 31)
                    h, start = headers(rec)
                    block = rec[start : start + int(h["content-length"])]
                    cut = block.index(b"\r\n\r\n") + 4
                    n = int(re.search(rb"(?i)content-length: (\d+)", block[:cut])[1])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response" and (len(block) - cut, hashlib.sha1(block[cut:]).hexdigest()) != (n, digest):
                        raise ValueError(f"the payload of {h['warc-record-id']} does not agree with its digest")
                    rows.append((page_of(h["warc-record-id"]), n, digest, h["warc-type"], page_of(h.get("warc-refers-to"))))
                frame_out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield frame_out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})

    data = spark.read.format("binaryFile").load(path).filter("kind = 'data'").select("archive", "content")
    return data.join(read_index(spark, path), "archive").select("content", "index").mapInPandas(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op3(spark: SparkSession, pages: DataFrame) -> DataFrame:
    raw, normal = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    write_monolithic(pages, raw)
    normalise(spark, raw, normal)
    return read_records(spark, normal)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN top IS NOT NULL AND top IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to
FROM m
"""
