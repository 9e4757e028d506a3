"""Removal of long repeated byte strings with a run-length compressed Burrows-Wheeler index.

A byte goes if it lies in a string of `WINDOW` bytes that also starts anywhere else. All windows are judged on the input.

1. Routing. Every window is known by the smallest hash among its grams of `k` bytes, so equal windows share
   it. Neighbouring windows with the same smallest hash are a piece of text, which travels under that hash. Every
   window is in one piece only. Pieces whose hash comes once, at one place, hold no repeated window and stop here.
2. Copies. Equal pieces count as one with a number; all windows of a piece that comes twice are repeated.
   Where a hash has one kind of piece only, that settles it.
3. Index. The different pieces of a hash go to one block of text. A block gets a suffix array, its BWT in runs, and samples
   of positions and match lengths at both ends of each run. The samples are enough: in text order the longest
   match of a position with its neighbour in the index is one shorter than that of the position before, except at
   run ends. So the matching statistics of the block against everything else in it stream out of the
   samples, and every window whose match is long enough is marked.
4. A hash whose pieces exceed `LIMIT` bytes is routed again on its own, by longer grams. With grams as long as a window every
   window is a piece and a hash has one kind of piece, so this ends, and no task holds more than a block.

Texts are known by two 64-bit hashes; equal texts are worked on once where they meet. Only pieces, positions and
the texts that lose something are shuffled (texts compressed).

Defined results: a null text is empty; texts shorter than a window lose nothing; repeated rows are copies of each
other, so both lose everything from `WINDOW` bytes on; matches never cross documents; an empty table gives no rows. A cut may
part the bytes of one character, which is why the result is bytes (or a digest).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import materialize

WINDOW = 200
GRAM = 64
BLOCK = 2_000_000  # bytes of pieces in an index
LIMIT = 4_000_000  # bytes of different pieces of one hash before it is routed again
PIECE = 1 << 14  # windows in a piece at most
STRETCH = 1 << 18  # bytes that are hashed at a time
SEPARATOR = 0xFF  # never a byte of UTF-8

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0], done = 1, 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(pow(base, done, 1 << 64))
        done += m
    return out


_UP = _powers(_BASE, STRETCH + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), STRETCH + 1)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes, by a polynomial modulo 2^64 that is mixed afterwards. At most STRETCH bytes."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[:n], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * _DOWN[: n - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every w neighbours, from running ones of blocks of w in both directions."""
    f, fill = (np.minimum, _MASK) if least else (np.maximum, 0)
    n = len(x)
    blocks = np.full(-(-n // w) * w, fill, dtype=np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    forth = f.accumulate(blocks, axis=1).reshape(-1)
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return f(back[: n - w + 1], forth[w - 1 : n])


def pieces(data: bytes, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, windows, many) of the pieces of a text; `many`: the hash is taken at two places of the piece."""
    found: list[tuple[np.ndarray, ...]] = []
    whole, step, w = np.frombuffer(data, dtype=np.uint8), STRETCH - window, window - k + 1
    for at in range(0, len(whole) - window + 1, step):
        part = whole[at : at + step + window - 1]
        h = gram_hashes(part, k)
        least = _sliding(h, w, True)
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        long = np.diff(np.append(starts, len(least)))
        most = PIECE if k < window else 1  # with grams as long as a window every window goes alone
        if (long > most).any():
            starts = np.concatenate([np.arange(s, s + n, most) for s, n in zip(starts, long, strict=True)])
            long = np.diff(np.append(starts, len(least)))
        # places that some window takes its hash from: equal to the largest of their windows' smallest hashes
        padded = np.concatenate([np.zeros(w - 1, dtype=np.uint64), least, np.zeros(w - 1, dtype=np.uint64)])
        taken = np.flatnonzero(_sliding(padded, w, False) == h)
        # the first and the last place of the piece's own hash; others may be taken in between
        mine, first, last = least[starts], np.searchsorted(taken, starts), np.searchsorted(taken, starts + long + w - 1) - 1
        for at_end, step_by in ((first, 1), (last, -1)):
            other = np.flatnonzero(h[taken[at_end]] != mine)
            while len(other):
                at_end[other] += step_by
                other = other[h[taken[at_end[other]]] != mine[other]]
        found.append((mine.view(np.int64), starts + at, long, first != last))
    if not found:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, bool))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- the index of one block -------------------------------------------------------------------------


def _packed(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, most significant first, zeros behind the end."""
    padded = np.concatenate([text, np.zeros(8, dtype=np.uint8)])
    out = np.zeros(len(text), dtype=np.uint64)
    for j in range(8):
        out = (out << np.uint64(8)) | padded[j : j + len(text)]
    return out


def suffix_array(text: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Prefix doubling from eight bytes; only suffixes that still share their rank are sorted again."""
    n = len(text)
    rank, sa = np.zeros(n, dtype=np.int64), np.argsort(packed)
    rows, keys, h = np.arange(n), packed[sa], 8
    while True:
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(rows)))
        rank[sa[rows]] = np.repeat(rows[heads], sizes)
        rows = rows[np.repeat(sizes > 1, sizes)]
        if not len(rows):
            return sa
        pos = sa[rows]
        after = np.where(pos + h < n, rank[np.minimum(pos + h, n - 1)] + 1, 0)
        keys = (rank[pos].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        order = np.argsort(keys)
        sa[rows], keys = pos[order], keys[order]
        h *= 2


def _common(text: np.ndarray, packed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, pair by pair."""
    n, out = len(text), np.zeros(len(a), dtype=np.int64)
    live, at = np.arange(len(a)), 0
    while len(live):
        x, y = a[live] + at, b[live] + at
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        diff = packed[x] ^ packed[y]
        same = diff == 0
        # leading equal bytes of the first word that differs
        bits = np.zeros(len(live), dtype=np.int64)
        for shift in (56, 48, 40, 32, 24, 16, 8):
            bits += (diff >> np.uint64(shift)) == 0
        out[live] = np.minimum(at + np.where(same, 8, bits), n - np.maximum(a[live], b[live]))
        live, at = live[same], at + 8
    return out


class RunLengthIndex:
    """The runs of a text's BWT, with positions and match lengths sampled at both ends of each run."""

    def __init__(self, text: np.ndarray):
        self.n = len(text)
        packed = _packed(text)
        sa = suffix_array(text, packed)
        bwt = text[sa - 1].astype(np.int16)
        bwt[sa == 0] = -1  # what stands before the text is no byte
        self.heads = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.chars = bwt[self.heads]
        self.first = sa[self.heads]  # sampled position at the first row of each run
        self.last = sa[np.append(self.heads[1:], self.n) - 1]  # and at the last row
        # match length of a run's first suffix with the one before it, which is the last of the run before
        self.match = np.concatenate([[0], _common(text, packed, self.last[:-1], self.first[1:])])

    def matching_statistics(self) -> np.ndarray:
        """Per position in text order: the longest match with any other position."""

        def stream(at: np.ndarray, length: np.ndarray) -> np.ndarray:
            # between samples a match gets one shorter with every position
            reach = np.full(self.n, -1, dtype=np.int64)
            reach[at] = length + at
            sample = np.maximum.accumulate(np.where(reach >= 0, np.arange(self.n), -1))
            return np.where(sample >= 0, reach[sample], 0) - np.arange(self.n)

        return np.maximum(stream(self.first, self.match), stream(self.last, np.append(self.match[1:], 0)))


def repeated_windows(parts: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each part: which of its windows also start anywhere else in the parts."""
    text = np.frombuffer(bytes([SEPARATOR]).join(parts) + bytes([SEPARATOR]), dtype=np.uint8)
    long = RunLengthIndex(text).matching_statistics() >= window
    out, at = [], 0
    for p in parts:
        out.append(long[at : at + len(p) - window + 1])
        at += len(p) + 1
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals: maximal runs."""
    order = np.argsort(starts)
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


# ---- Spark ------------------------------------------------------------------------------------------


def _routes(texts: DataFrame, k: int, window: int) -> DataFrame:
    """texts: t1, t2, base, z (compressed bytes). A row per piece: h, d (digest of the piece), t1, t2, base, start, n, many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for row, data in enumerate(batch.column("data")):
                raw = data.as_py()
                if raw is None or len(raw) < window:
                    continue
                view = memoryview(raw)
                h, start, n, many = pieces(raw, k, window)
                digest = xxhash.xxh3_64_intdigest
                d = np.array([digest(view[s : s + c + window - 1]) for s, c in zip(start.tolist(), n.tolist(), strict=True)], dtype=np.uint64).view(np.int64)
                for col, x in zip(out, (np.full(len(h), row), h, d, start, n, many), strict=True):
                    col.append(x)
            if out[0]:
                row, h, d, start, n, many = (np.concatenate(x) for x in out)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(d), batch.column("t1").take(take), batch.column("t2").take(take), batch.column("base").take(take), pa.array(start), pa.array(n), pa.array(many)],
                    names=["h", "d", "t1", "t2", "base", "start", "n", "many"])

    return texts.select("t1", "t2", "base", "data").mapInArrow(run, "h long, d long, t1 long, t2 long, base long, start long, n long, many boolean")


def _cut(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The bytes of wanted pieces (t1, t2, base, and their own columns h, d, start, n, c) from their texts."""
    packed = _compressed(texts)
    per_text = wanted.groupBy("t1", "t2", "base").agg(F.collect_list(F.struct("h", "d", "start", "n", "c")).alias("ps"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for frame in frames:
            rows = []
            for t1, t2, base, z, ps in frame.itertuples(index=False):
                raw = unzip.decompress(z)
                rows += [(p["h"], p["d"], t1, t2, base + p["start"], p["c"], raw[p["start"] : p["start"] + p["n"] + window - 1]) for p in ps]
            yield pd.DataFrame(rows, columns=["h", "d", "t1", "t2", "start", "c", "piece"])

    joined = per_text.join(packed, ["t1", "t2", "base"]).select("t1", "t2", "base", "z", "ps")
    return joined.mapInPandas(run, "h long, d long, t1 long, t2 long, start long, c long, piece binary")


def _compressed(texts: DataFrame) -> DataFrame:
    """One row per different text: t1, t2, base, z. Texts are compressed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([zip_.compress(x.as_py() or b"") for x in batch.column("data")], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), batch.column("base"), z], names=["t1", "t2", "base", "z"])

    return texts.select("t1", "t2", "base", "data").mapInArrow(run, "t1 long, t2 long, base long, z binary").dropDuplicates(["t1", "t2", "base"])


def _indexed(cut: DataFrame, window: int) -> DataFrame:
    """Marked windows (t1, t2, start, n) of the pieces that come once, from indexes of whole groups of a hash."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0

        def marked() -> pd.DataFrame:
            rows = []
            found = repeated_windows([bytes(x.piece) for x in held], window)
            for x, marks in zip(held, found, strict=True):
                if x.c > 1 or not marks.any():
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
                rows += [(x.t1, x.t2, x.start + int(s), int(e - s)) for s, e in zip(edge[::2], edge[1::2], strict=True)]
            return pd.DataFrame(rows, columns=["t1", "t2", "start", "n"], dtype="int64")

        for frame in frames:
            for x in frame.itertuples(index=False):
                if held and size > BLOCK and x.h != held[-1].h:
                    yield marked()
                    held, size = [], 0
                held.append(x)
                size += len(x.piece)
        if held:
            yield marked()

    dealt = cut.repartition("h").sortWithinPartitions("h")
    return dealt.mapInPandas(run, "t1 long, t2 long, start long, n long")


def _level(texts: DataFrame, k: int, window: int) -> list[DataFrame]:
    """Tables of marked windows (t1, t2, start, n) of these texts."""
    routes = _routes(texts, k, window)
    sizes = routes.groupBy("h").agg(F.count(F.lit(1)).alias("all"), F.max("many").alias("any_many")).filter("all > 1 OR any_many")
    flagged = materialize(routes.join(sizes.select("h"), "h"), "suffix-pieces")
    kinds = flagged.groupBy("h", "d").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("t1", "t2", "base", "start", "n")).alias("p"), F.max("many").alias("many"))
    kinds = materialize(kinds, "suffix-kinds")
    # every window of a piece that comes twice is repeated
    copies = kinds.filter("c > 1").select("h", "d")
    tables = [flagged.join(copies, ["h", "d"]).select("t1", "t2", (F.col("base") + F.col("start")).alias("start"), "n")]
    # hashes with pieces of several kinds, or one that may repeat a window within itself, need the index
    groups = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum(F.col("p.n") + window - 1).alias("bytes"), F.max(F.col("many") & (F.col("c") == 1)).alias("within"))
    groups = materialize(groups.filter("kinds > 1 OR within"), "suffix-groups")
    wanted = kinds.join(groups, "h").select("h", "d", "c", "p.*", "bytes")
    cut = _cut(texts, wanted.filter(F.col("bytes") <= LIMIT).drop("bytes"), window)
    tables.append(_indexed(cut, window))
    if not groups.filter(F.col("bytes") > LIMIT).isEmpty():
        # a piece that comes twice must still count twice when it is cut again
        hot = wanted.filter(F.col("bytes") > LIMIT).drop("bytes")
        again = materialize(_cut(texts, hot, window).withColumn("copy", F.explode(F.expr("sequence(1L, least(c, 2L))"))).select(
            "t1", "t2", F.col("start").alias("base"), F.col("piece").alias("data")), "suffix-again")
        tables += _level(again, min(window, k + (window - k + 1) // 2 + 1), window)
    return tables


def repeated_spans(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per different text that loses something: t1, t2, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    texts = _texts(docs, text)
    tables = _level(texts, gram, window)
    marks = tables[0]
    for t in tables[1:]:
        marks = marks.union(t)
    marks = marks.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "n")).alias("ms"))
    marks = materialize(marks, "suffix-marks")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        for frame in frames:
            rows = []
            for t1, t2, ms, z in frame.itertuples(index=False):
                raw = unzip.decompress(z)
                s = np.array([m["start"] for m in ms], dtype=np.int64)
                lo, hi = spans(s, s + np.array([m["n"] for m in ms], dtype=np.int64) + window - 1)
                kept = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
                rows.append((t1, t2, int((hi - lo).sum()), len(lo), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(rows, columns=["t1", "t2", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = marks.join(_compressed(texts).drop("base"), ["t1", "t2"]).select("t1", "t2", "ms", "z")
    return joined.mapInPandas(run, "t1 long, t2 long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _texts(docs: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), F.lit(0).cast("long").alias("base"), t.cast("binary").alias("data"))


def op9(docs: DataFrame) -> DataFrame:
    found = materialize(repeated_spans(docs).drop("kept"), "suffix-results")
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("whole"))
    return rows.join(found, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
