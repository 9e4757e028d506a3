"""SimHash near-duplicates by pigeonhole blocks.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set. Fingerprints link if they
differ in `distance` bits at most. The bits are split into `distance + 2` blocks; two such fingerprints agree in
two blocks at least, so joining on every pair of blocks finds all links. Only different fingerprints are compared:
equal ones are one node, whatever their number.

Within a group of fingerprints that agree in two blocks, a task does not write all close pairs: it walks
from fingerprint to unvisited close ones and writes one link for each that it reaches. That is a spanning forest with the
same components. A group larger than `SPLIT` is split again by the same rule over its remaining bits, which bounds
a group by 2^23 fingerprints at 64 bits and 3 differing ones.

Defined results: a text without words (null too) has fingerprint zero and links like any other; a text of fewer words
than a shingle is one shingle. Repeated rows share a component. A null doc_id never names a component unless all ids of
the component are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import materialize
from tabrisk.llm.components import components

BITS = 64
SEED = 42
SPLIT = 4096  # fingerprints in a group before it is split again
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of `size` words; of all words together if there are fewer; none without words."""
    words = WORD_BYTES.findall((text or "").encode("utf-8", "replace").translate(LOWER))
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    parts = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(p, SEED) for p in parts], dtype=np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: bits that over half of the hashes have set."""
    if not len(hashes):
        return 0
    set_in = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        part = np.ascontiguousarray(hashes[at : at + 4096]).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed 64-bit integer."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fold(shingle_hashes(t.as_py(), size)) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp bigint")
    return rows.withColumnRenamed("key", key)


def _masks(free: int, blocks: int, agree: int) -> list[int]:
    """The masks of all choices of `agree` blocks, when the set bits of `free` are dealt to `blocks` blocks."""
    bits = [i for i in range(BITS) if free >> i & 1]
    edges = [len(bits) * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[edges[k] : edges[k + 1]]) for k in range(blocks)]
    return [sum(chosen) for chosen in combinations(parts, agree)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join exactly those fingerprints of a group that steps of `distance` bits join."""
    a, b = [], []
    rest = np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
    empty = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def _group_links(groups: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within each row's array `fps`."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fps in frame["fps"]:
                a, b = _spanning_links(np.asarray(fps, dtype=np.int64).view(np.uint64), distance)
                if len(a):
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    # groups are few bytes and much work: dealt out by number, not merged by size into one task
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.select("fps").repartition(parts).mapInPandas(run, "a bigint, b bigint")


def _keyed(fps: DataFrame, table: Column, masks: list[tuple[Column, int]]) -> DataFrame:
    """Each fingerprint once for every mask: (prefix columns of fps, t, k, fp)."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in masks]))
    return fps.select(*table, keys.alias("x"), "fp").select(*table, "x.t", "x.k", "fp")


def close_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of different fingerprints, enough to join all that chains of links join.

    `fps` has one column `fp` without repeats.
    """
    blocks, agree = distance + 2, 2
    whole = (1 << BITS) - 1
    masks = _masks(whole, blocks, agree)
    keyed = materialize(_keyed(fps, [], list(enumerate(masks))), "simhash-keys")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = materialize(sizes, "simhash-sizes")
    small = keyed.join(sizes.filter(F.col("n") <= SPLIT).select("t", "k"), ["t", "k"], "left_semi")
    links = _group_links(small.groupBy("t", "k").agg(F.collect_list("fp").alias("fps")), distance)
    large = keyed.join(sizes.filter(F.col("n") > SPLIT).select("t", "k"), ["t", "k"], "left_semi")
    # a large group agrees in the blocks of its table; its links differ in `distance` of the other bits at most, so
    # they agree in two blocks of those again
    inner = [(t, j, m) for t, mask in enumerate(masks) for j, m in enumerate(_masks(whole & ~mask, blocks, agree))]
    per_table = F.create_map(*[x for t in range(len(masks)) for x in (F.lit(t), F.array(*[F.lit(_signed(m)) for u, _, m in inner if u == t]))])
    split = large.select("t", "k", "fp", F.posexplode(F.element_at(per_table, F.col("t"))).alias("j", "m"))
    split = split.select("t", "k", "j", F.col("fp").bitwiseAND(F.col("m")).alias("k2"), "fp")
    again = split.groupBy("t", "k", "j", "k2").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return links.union(_group_links(again, distance))


def near_duplicates(docs: DataFrame, size: int = 5, distance: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component): component is the smallest key of all documents that links join to this one."""
    prints = materialize(fingerprints(docs, size, text, key), "simhash")
    firsts = materialize(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    joined = components(close_links(firsts.select("fp"), distance))
    named = firsts.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    of_fp = named.join(least, "component").select("fp", F.col("least").alias("component"))
    return prints.join(materialize(of_fp, "simhash-components"), "fp").select(key, "fp", "component")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit integer."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_of_each(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """`docs` without near-duplicates: of each component the row with the smallest doc_id stays; a null one comes last.

    Rows of one doc_id, or without any, are told apart by hashes of text and row; of truly equal rows one stays.
    """
    cols = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.xxhash64(*[F.to_json(c) if "map<" in docs.schema[n].dataType.simpleString() else c for n, c in zip(docs.columns, cols, strict=True)])
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), whole.alias("rh"))
    found = near_duplicates(docs.select(rank.alias("rank"), "text"), size, distance, key="rank")

    # one key that is never null: the join and the removal of equal rows then share one shuffle of the texts
    def key(r: Column) -> Column:
        return F.concat_ws("|", r["none"].cast("int"), r["th"], r["rh"], F.coalesce(r["id"].cast("string"), F.lit("")))

    stay = found.filter(F.col("rank") == F.col("component")).select(key(F.col("rank")).alias("__key")).distinct()
    rows = docs.select(F.struct(*cols).alias("__row"), key(rank).alias("__key"))
    # equal rows are combined before they travel; the join then finds them where they are
    return rows.dropDuplicates(["__key"]).join(stay, "__key", "left_semi").select("__row.*")


def op7(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs, 3, 3)
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
