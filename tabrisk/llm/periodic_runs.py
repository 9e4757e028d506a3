"""Periodic runs of words: stretches that repeat with a period, three times or more.

A run is a stretch of consecutive words whose smallest period is q (words q apart are identical), of at least
max(`MIN_LENGTH`, `MIN_TIMES` * q) words, that no neighbouring word extends with period q.

Seed and extend on diagonals. A run of period q and length L agrees with itself shifted by q over L - q words, which are at
least `MIN_LENGTH` - q and at least 2q. So for q up to 16 it holds equal 16-grams q apart, and for q in (k/2, k] with k = 32,
64, ... equal k-grams q apart: the overlap that is guaranteed.

1. An index names the k-grams of a text exactly, by numbers; those of 2k words are pairs of those of k words. A gram that
   occurs once can't be part of a longer one that occurs twice, so the index shrinks from level to level.
2. The occurrence pairs of the index are neighbouring occurrences of a gram whose distance lies in the level's range of
   periods. Neighbours are enough: were a gram inside a run found again at a distance d below q, then the d + k >= d + q words
   from there on would have periods d and q, and so the period gcd(d, q) < q, and with them the whole run. By the same
   reason a stretch of three periods found in this way has no period below q. So a text of n words has n pairs at most
   at a level, however often a gram occurs, and no pair of distant occurrences is written.
3. Pairs are taken by lag and place. A table holds for each lag how far the last extension reached: a pair below is skipped,
   any other one is extended in both directions while words q apart agree, in blocks that double.

The work is O(n log n) for a text of n words, whatever it repeats; Spark deals out the rows, and a row is never split.

Defined results: a null, empty or blank text has no words and no runs; its collapsed text is empty. Repeated rows and rows with a
null key get results of their own. Runs of different periods may overlap; equal ratios are told apart by start, then
period. An empty table gives an empty result. The row travels as one column, so no name of its own can clash; added columns
replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import let, words

# Fixed values of the contract.
MIN_LENGTH, MIN_TIMES = 24, 3
#: shortest gram of the index: the least overlap of a run with itself, over all periods
SEED = min(max(MIN_LENGTH - q, (MIN_TIMES - 1) * q) for q in range(1, MIN_LENGTH))


def _agree(ids: np.ndarray, at: int, lag: int, stop: int, step: int) -> int:
    """The first place from `at` in the direction `step` where ids[place] != ids[place + lag], or `stop`."""
    size = 64
    while at != stop:
        size = min(size, abs(stop - at))
        lo = at if step > 0 else at - size + 1
        same = ids[lo:lo + size] == ids[lo + lag:lo + lag + size]
        if not same.all():
            return at + int(np.argmin(same)) if step > 0 else at - int(np.argmin(same[::-1]))
        at, size = at + step * size, size * 2
    return stop


def _pairs(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lags) of neighbouring occurrences of equal grams, level by level of the index."""
    n, k = len(ids), 1
    at, name = np.arange(n), ids
    while len(at) and k <= n:
        if k >= SEED:
            order = np.lexsort((at, name))
            p, g = at[order], name[order]
            lag = p[1:] - p[:-1]
            on = (g[1:] == g[:-1]) & (lag <= k) & (lag > (0 if k == SEED else k // 2))
            yield p[:-1][on], lag[on]
        # grams of 2k words: both halves must occur more than once themselves
        of = np.full(n, -1, dtype=np.int64)
        of[at] = name
        at = at[at + k < n]
        pair = np.stack([of[at], of[at + k]])
        on = (pair >= 0).all(axis=0)
        at, pair = at[on], pair[:, on]
        _, name, count = np.unique(pair[0] * (n + 1) + pair[1], return_inverse=True, return_counts=True)
        twice = count[name] > 1
        at, name, k = at[twice], name[twice], 2 * k


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text given as word numbers, by start, then period."""
    found, n = [], len(ids)
    for places, lags in _pairs(ids):
        order = np.lexsort((places, lags))
        places, lags = places[order], lags[order]
        i = 0
        covered: dict[int, int] = {}
        while i < len(places):
            q, at = int(lags[i]), int(places[i])
            reach = covered.get(q, 0)
            if at < reach:
                # on to the first pair of this lag beyond the reach, or to the next lag
                last = int(np.searchsorted(lags, q, "right"))
                i += int(np.searchsorted(places[i:last], reach, "left"))
                continue
            stop = _agree(ids, at, q, n - q, 1)
            start = _agree(ids, at, q, max(reach, 0) - 1, -1) + 1
            covered[q] = stop
            if stop - start + q >= max(MIN_LENGTH, MIN_TIMES * q):
                found.append((start, stop - start + q, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of_text(text: str | None) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the words that are left when each run keeps its first period, joined by one space."""
    ws = (text or "").encode().split()  # of bytes: splits at 0x20 and 0x09-0x0D only
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws))
    if len(number) == len(ws):
        return len(ws), [], b" ".join(ws).decode()
    found = runs_of(ids)
    if found:
        gone = np.zeros(len(ws) + 1, dtype=np.int64)
        for start, length, q in found:
            gone[start + q] += 1
            gone[start + length] -= 1
        ws = [w for w, g in zip(ws, np.cumsum(gone), strict=False) if not g]
    return len(ids), found, b" ".join(ws).decode()


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, runs (array of start, length, period, by start, then period) and collapsed (the text without the
    repetitions, words joined by one space)."""
    keep = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    # an empty struct has no Arrow form, so a constant goes with it
    rows = docs.select(F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep, 1)]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [runs_of_text(t) for t in batch.column(1).to_pylist()]
            runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in m[1]] for m in made], RUNS)
            cols = [batch.column(0), pa.array([m[0] for m in made], pa.int64()), runs, pa.array([m[2] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(keep, 1)], "n_words", "runs", "collapsed")


def planted(key: Column, text: Column) -> Column:
    """The contract's text: in a tenth of the documents the words from a place on repeat with a period. A document without
    a key is none of them."""
    h = F.crc32(key.cast("string"))

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(h / 10).cast("long")
        place = let(g % n, lambda a: F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).cast("long").alias("p")))
        at = lambda i, x: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        return let(place, lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, at(i, x).cast("int"))), " "))

    return F.when((h % 10 == 0) & F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), let(words(text), repeat)).otherwise(text)


def op11(docs: DataFrame) -> DataFrame:
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # the greatest exact ratio; runs stand by start, then period, so the first of equal ones stays
    better = lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x)
    best = F.reduce("runs", F.get("runs", F.lit(0)), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    log = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(log, 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"), best.alias("best")).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
