"""Line dedup: pairs of documents are aligned, and common blocks go from the later one.

1. Every line with a word becomes a hash. A window is the shortest run of neighbouring lines with `min_words` words or more,
   from each line on and up to each line. Each line has a word, so a window has `min_words` lines at most, and a line starts
   or ends two windows at most. Every run of `min_words` words or more is covered by windows inside it.
2. A window found in several documents pairs each later one with the first one that has it: a document is later if its id is
   larger. A window shared by very many documents makes one pair for each of them, not one for every two, and no window is
   too frequent to count; what two later documents share beyond that stands in windows of its own, with a first holder of
   its own. So each document is paired with earlier ones that have, between them, all it shares with any earlier one.
3. A pair is aligned by patience diff over the windows they share: common head and tail, then the longest increasing run of
   windows that occur once in both, then the gaps between them again. Windows that were left over, because two passages
   stand in another order, are aligned again among themselves, until none is left.
4. Neighbouring windows that are aligned at the same distance are a block. The blocks of all its pairs are deleted from the
   later document: a line goes exactly if it is in a run of `min_words` words or more that some earlier document has as
   neighbouring lines too. A line always stays in the first document that holds it.

Lines are compared without leading and trailing white space. Blank lines are never compared and never deleted; they don't
part a block.

Defined results: a null or empty text has no lines and stays as it is. Rows that share key and text are one document and
lose the same lines; rows that share only the key are different documents, in the order of a text hash. A null key comes
before all others; keys of any type that Spark can order will do. An empty table gives an empty result. Of equal runs in two
orders the alignment that patience diff reaches last wins; what is deleted does not depend on it. Columns other than the
text stay as they are, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import SPACES, materialize, word_count

MIN_WORDS = 5


def _matched(a: list[int], b: list[int], lo_a: int, hi_a: int, lo_b: int, hi_b: int) -> list[tuple[int, int]]:
    """Patience diff: index pairs of equal entries, increasing in both."""
    found, todo = [], [(lo_a, hi_a, lo_b, hi_b)]
    while todo:
        lo_a, hi_a, lo_b, hi_b = todo.pop()
        while lo_a < hi_a and lo_b < hi_b and a[lo_a] == b[lo_b]:
            found.append((lo_a, lo_b))
            lo_a, lo_b = lo_a + 1, lo_b + 1
        while lo_a < hi_a and lo_b < hi_b and a[hi_a - 1] == b[hi_b - 1]:
            hi_a, hi_b = hi_a - 1, hi_b - 1
            found.append((hi_a, hi_b))
        if lo_a == hi_a or lo_b == hi_b:
            continue
        count_a, count_b = Counter(a[lo_a:hi_a]), Counter(b[lo_b:hi_b])
        at_a = {h: i for i, h in enumerate(a[lo_a:hi_a], lo_a) if count_a[h] == 1}
        once = [(at_a[h], j) for j, h in enumerate(b[lo_b:hi_b], lo_b) if count_b[h] == 1 and h in at_a]
        # longest increasing run of the positions in a, in the order of b
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (i, _) in enumerate(once):
            p = bisect_left(tops, i)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(i)
                piles.append(n)
            else:
                tops[p], piles[p] = i, n
        n, run = (piles[-1] if piles else -1), []
        while n >= 0:
            run.append(once[n])
            n = back[n]
        if not run:
            continue
        found += run
        edges = [(lo_a - 1, lo_b - 1), *run[::-1], (hi_a, hi_b)]
        todo += [(x + 1, i, y + 1, j) for (x, y), (i, j) in zip(edges, edges[1:], strict=False)]
    return sorted(found)


def aligned(shared: list[tuple[int, list[int], list[int]]]) -> list[tuple[int, int, int]]:
    """Blocks (start, stop, start in the earlier document) of a later document, in its order.

    shared: of every window that both have its number of lines, its places in the later and in the earlier document.
    """
    size = [n for n, _, _ in shared]
    early = sorted((i, t) for t, (_, _, places) in enumerate(shared) for i in places)
    late = sorted((i, t) for t, (_, places, _) in enumerate(shared) for i in places)
    names = [t for _, t in early]
    at: dict[int, int] = {}  # place in the later document -> place in the earlier one
    while late:
        found = _matched(names, [t for _, t in late], 0, len(names), 0, len(late))
        for i, j in found:
            at[late[j][0], late[j][1]] = early[i][0]
        taken = {j for _, j in found}
        rest = [x for j, x in enumerate(late) if j not in taken]
        if len(taken) * 8 < len(late):
            # hardly any order is left to find (reversed or repeated windows): each goes to its first place, as it would one by one
            at.update({x: shared[x[1]][2][0] for x in rest})
            rest = []
        late = rest
    blocks: list[list[int]] = []
    for (j, t), i in sorted(at.items()):
        if blocks and j <= blocks[-1][1] and i - j == blocks[-1][2] - blocks[-1][0]:
            blocks[-1][1] = max(blocks[-1][1], j + size[t])
        else:
            blocks.append([j, j + size[t], i])
    return [tuple(x) for x in blocks]


def _mixed(acc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hash of a run from that of the run without its last line, and that line's hash."""
    x = acc * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_of(h: np.ndarray, w: np.ndarray, sizes: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and hash of the windows of documents of `sizes` lines; h and w: hash and words of all their lines."""
    stops = np.cumsum(sizes)
    begin, end = np.repeat(stops - sizes, sizes), np.repeat(stops, sizes)
    before = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(w)])
    at, least = np.arange(len(h)), max(1, min_words)
    to = np.searchsorted(before, before[:-1] + least, "left")
    on = to <= end
    since = np.searchsorted(before, before[1:] - least, "right") - 1
    back = since >= begin
    back[back] = to[since[back]] != at[back] + 1  # else it is a window from its first line on, too
    start, stop = np.concatenate([at[on], since[back]]), np.concatenate([to[on], at[back] + 1])
    acc = np.zeros(len(start), dtype=np.uint64)
    for k in range(int((stop - start).max(initial=0))):
        more = start + k < stop
        acc[more] = _mixed(acc[more], h[start[more] + k])
    return start, stop, acc


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """rows: id, th, h, w. (id, th, wh, size, places): of every different window of a document its hash, lines and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ws = batch.column(2), batch.column(3)
            sizes = hs.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h, w = (x.flatten().to_numpy(zero_copy_only=False) for x in (hs, ws))
            start, stop, wh = windows_of(h.astype(np.int64).view(np.uint64), w.astype(np.int64), sizes, min_words)
            of = np.repeat(np.arange(len(sizes)), sizes)[start]
            order = np.lexsort((start, wh, of))
            start, stop, wh, of = start[order], stop[order], wh[order], of[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (wh[1:] != wh[:-1])
            first = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(of)).astype(np.int32)), pa.array((start - (np.cumsum(sizes) - sizes)[of]).astype(np.int32)))
            taken = pa.array(of[first])
            cols = [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(wh[first].view(np.int64)), pa.array((stop - start)[first].astype(np.int32)), places]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "th", "wh", "size", "places"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, th long, wh long, size int, places array<int>")


def _align(pairs: DataFrame) -> DataFrame:
    """pairs: id, th, shared (array of earlier document, size, places, places there). Adds up the blocks of each document's pairs."""
    kind = pairs.schema["shared"].dataType.elementType["a"].dataType["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, gone = [], []
            for row in batch.column(2):
                by_pair: dict[tuple, set] = {}
                for x in row.as_py():
                    by_pair.setdefault((x["a"]["id"], x["a"]["th"]), set()).add((x["size"], tuple(x["places"]), tuple(x["there"])))
                found = [{"earlier": a, "start": i, "stop": j, "there": k} for (a, _), shared in by_pair.items() for i, j, k in aligned(sorted(shared))]
                out.append(sorted(found, key=lambda b: (b["start"], b["stop"], str(b["earlier"]), b["there"])))
                gone.append(sorted({n for b in found for n in range(b["start"], b["stop"])}))
            blocks = pa.array(out, pa.list_(pa.struct([("earlier", batch.column(0).type), ("start", pa.int64()), ("stop", pa.int64()), ("there", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), blocks, pa.array(gone, pa.list_(pa.int64()))], names=["id", "th", "blocks", "gone"])

    return pairs.mapInArrow(run, f"id {kind}, th long, blocks array<struct<earlier:{kind},start:long,stop:long,there:long>>, gone array<long>")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lost_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, blocks, gone): per document, given by key and text hash, its blocks (with the earlier document and the place
    they are aligned with) and the places among its lines with words that go."""
    t = F.coalesce(F.col(text), F.lit(""))
    worded = F.filter(F.transform(_lines(F.col(text)), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")
    packed = F.transform(worded, lambda x: F.struct(F.xxhash64(x).alias("h"), word_count(x).alias("w")))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(t).alias("th"), packed.alias("ls"))
    found = _windows(rows.select("id", "th", F.col("ls.h").alias("h"), F.col("ls.w").alias("w")), min_words)
    found = materialize(found.select("wh", F.struct("id", "th").alias("d"), "size", "places"), "line-windows")
    # the first holder of a window, with its places there; equal rows are one document and agree in them
    firsts = found.groupBy("wh").agg(F.min(F.struct("d", "places")).alias("f"), F.max("d").alias("last")).filter("f.d <> last")
    later = found.join(firsts.select("wh", F.col("f.d").alias("a"), F.col("f.places").alias("there")), "wh").filter("d > a")
    # all pairs of a document, which has no more windows than lines allow
    pairs = later.groupBy("d").agg(F.collect_set(F.struct("a", "size", "places", "there")).alias("shared"))
    return materialize(_align(pairs.select("d.id", "d.th", "shared")), "line-gone")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with its columns and the text without deleted lines; adds n_lines and n_removed as `__n_lines`, `__n_removed`."""
    gone = lost_lines(docs, text, key, min_words).select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    # the row travels as one column, so that no name of its own can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(key).alias("__k"),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h"))
    joined = rows.join(gone, F.col("__k").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    old = F.col(f"__row.`{text}`")
    all_lines = F.transform(_lines(old), lambda x: F.struct(x.alias("x"), (F.btrim(x, F.lit(SPACES)) != "").cast("long").alias("k")))

    # places of the lines with words, in order; those that go become line numbers
    def numbers(ls: Column) -> Column:
        return F.filter(F.transform(ls, lambda x, i: F.when(x["k"] == 1, i)), lambda i: i.isNotNull())

    def rest(ls: Column) -> Column:
        at = numbers(ls)
        dropped = F.transform(F.array(at), lambda a: F.transform(F.col("__gone"), lambda p: F.get(a, p.cast("int"))))[0]
        stay = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), dropped)
        return F.array_join(F.transform(stay, lambda i: F.get(ls, i)["x"]), "\n")

    new = F.when(F.col("__gone").isNull(), old).otherwise(F.transform(F.array(all_lines), rest)[0])
    kept = [(new if c == text else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns]
    n_lines = F.size(F.filter(_lines(old), lambda x: F.btrim(x, F.lit(SPACES)) != "")).cast("long")
    n_gone = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    return joined.select(*kept, n_lines.alias("__n_lines"), n_gone.alias("__n_removed"))


def without_repeated_blocks(docs: DataFrame) -> DataFrame:
    """`docs` with its own columns; n_chars, where there is such a column, is counted again."""
    out = dedup_lines(docs).drop("__n_lines", "__n_removed")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
