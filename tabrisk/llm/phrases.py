"""Phrase collocations by count transducers.

1. Each task turns the texts it reads into sorted n-grams of one to `LONGEST` words, language by language and at most `CHUNK` words
   at a time, and builds a transducer of their counts (`transducers`).
2. Bounds cut the order of all n-grams into prefix ranges of about equal size. They come from a sample of documents, which
   moves the bounds only, not the result. A frequent prefix is cut inside, by the words that follow, so no n-gram, word or
   language makes a range larger than others. Each shard's transducer is cut at the bounds and its parts are sent to their ranges.
3. A range unites its parts and adds their weights up. N-grams below `MIN_COUNT` are pruned: no candidate, no part of one and nothing
   longer is among them, as a phrase is never more frequent than its parts.
4. Part lookups by composition: a range collects the parts of its candidates, different ones only, as acceptors for the ranges that
   hold them; these compose them with their counts and send them back. A part that very many phrases share is asked once by
   each range.
5. A candidate is scored at each cut by exact decimals; the lowest cut counts. The most frequent longer candidate around each
   phrase is found by aggregating longer candidates by the phrases inside them.

Words and pieces are those of the contract: A-Z in lower case, pieces between `[.,;:!?\\x0A-\\x0D]`, words `[^\\x20\\x09]+`.

Defined results: a null text is empty, a null language is `und`, one language with rows that say `und`. Repeated rows count as often as
they stand there. Equal scores go by count, then phrase in byte order. A language without candidates has no rows; an empty table
gives an empty result. Only the text and language columns are read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabrisk.llm.common import materialize
from tabrisk.llm.transducers import Gram, Transducer

# Fixed values of the contract.
LONGEST, MIN_COUNT, SCALE, INSIDE, LIMIT = 4, 30, 2_000_000, 80, 2000
#: words a task holds before it builds transducers of them; words of the input for each range
CHUNK, RANGE_WORDS = 3_000_000, 750_000
#: documents and n-grams for each range, on average, in the sample for the bounds
SAMPLE_DOCS, SAMPLE_GRAMS = 2000, 40

_TABLE = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz........."))


def tokens_of(text: str | None) -> list[bytes]:
    """The words of a text; `.`, which is no word, between pieces. Of bytes, so that no other white space splits."""
    return (text or "").encode().translate(_TABLE).replace(b".", b" . ").split()


class _Shard:
    """Texts of one language on their way to a transducer."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict(count().__next__)
        self.seqs: list[np.ndarray] = []
        self.number[b"."]

    def add(self, text: str | None) -> int:
        tokens = [*tokens_of(text), b"."]
        self.seqs.append(np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens)) - 1)
        return len(tokens)

    def built(self) -> Transducer:
        return Transducer.of_tokens(np.concatenate(self.seqs), list(self.number)[1:], LONGEST)


def _shards(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, Transducer]]:
    """(language, transducer) of the rows (lang, text) of a task."""
    held: dict[str, _Shard] = defaultdict(_Shard)
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            size += held[lang.as_py()].add(text.as_py())
            if size >= chunk:
                yield from ((k, held.pop(k).built()) for k in sorted(held))
                size = 0
    yield from ((k, held.pop(k).built()) for k in sorted(held))


def _rows(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))


def range_bounds(rows: DataFrame) -> list[tuple[str, Gram]]:
    """Sorted (language, n-gram) bounds between ranges of about equal numbers of different n-grams; at most as many as there are ranges."""
    total = rows.count()
    if not total:
        return []
    sample = materialize(rows.sample(min(1.0, SAMPLE_DOCS / total), seed=1), "phrase-sample")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09]+"))
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(words), F.lit(0)).alias("w")).first()
    ranges = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-int(seen["w"] * total / max(1, seen["n"])) // RANGE_WORDS))
    # of the sample's different n-grams those with the smallest digests
    share = min(1.0, 2 * SAMPLE_GRAMS * ranges / max(1, seen["w"]))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(1)
        for lang, made in _shards(batches, CHUNK):
            found = [g for g, _ in made.grams()]
            found = [g for g, x in zip(found, rng.random(len(found)), strict=True) if x < share]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.binary())], names=["lang", "gram"])

    found = sample.mapInArrow(grams, "lang string, gram binary").distinct()
    rows_ = found.orderBy(F.xxhash64("lang", "gram")).limit(SAMPLE_GRAMS * ranges).collect()
    keys = sorted((r["lang"], tuple(bytes(r["gram"]).split(b" "))) for r in rows_)
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _in_lang(bounds: list[tuple[str, Gram]], lang: str) -> tuple[int, list[Gram]]:
    """Number of the first range of a language, and the bounds inside it."""
    lo, hi = bisect_left(bounds, (lang, ())), bisect_left(bounds, (lang + "\0", ()))
    return lo, [g for _, g in bounds[lo:hi]]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


# home: the range of the candidates; at: the range that works on the row; kind: 0 counts, 1 acceptors or answers
_ROWS = pa.schema([("home", pa.int32()), ("at", pa.int32()), ("kind", pa.int32()), ("lang", pa.string()), ("data", pa.binary())])
_ROWS_DDL = "home int, at int, kind int, lang string, data binary"


def _parts(gram: bytes) -> Iterator[tuple[bytes, bytes]]:
    words = gram.split(b" ")
    for k in range(1, len(words)):
        yield b" ".join(words[:k]), b" ".join(words[k:])


def count_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, k, a, l, r) of every candidate and cut, and (lang, n): the words of each language."""
    rows = _rows(docs, text, lang)
    bounds = range_bounds(rows)
    ranges = len(bounds) + 1

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, made in _shards(batches, CHUNK):
            first, inside = _in_lang(bounds, lang)
            out = [(0, first + i, 0, lang, part.dump()) for i, part in enumerate(made.cut(inside)) if len(part)]
            if out:
                yield _batch(out, _ROWS)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[str, list[Transducer]] = defaultdict(list)
        here = 0
        for batch in batches:
            for at, lang, data in zip(batch.column(1), batch.column(3), batch.column(4), strict=True):
                here, parts = at.as_py(), whole[lang.as_py()]
                parts.append(Transducer.load(data.as_py()))
                # the first one is the union so far; the others wait until they are as large
                if sum(map(len, parts[1:])) > max(1 << 19, len(parts[0])):
                    parts[:] = [Transducer.union(parts)]
        for lang in sorted(whole):
            made = Transducer.union(whole.pop(lang))
            n = int(made.levels[0][2].sum())
            made = made.pruned(min_count)
            asks: dict[int, set[bytes]] = defaultdict(set)
            first, inside = _in_lang(bounds, lang)
            for gram, _ in made.grams():
                for pair in _parts(gram):
                    for part in pair:
                        asks[first + bisect_right(inside, tuple(part.split(b" ")))].add(part)
            out = [(here, here, 0, lang, made.dump()), (here, here, 2, lang, str(n).encode())]
            out += [(here, to, 1, lang, Transducer.of_grams(sorted(tuple(g.split(b" ")) for g in asks[to]), LONGEST).dump()) for to in sorted(asks)]
            yield _batch(out, _ROWS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Transducer] = {}
        for batch in batches:
            out = []
            for home, at, kind, lang, data in zip(*batch.columns, strict=True):
                lang, data = lang.as_py(), Transducer.load(data.as_py())
                if kind.as_py() == 0:
                    counts[lang] = data
                else:
                    out.append((home.as_py(), at.as_py(), 1, lang, data.composed(counts[lang]).dump()))
            if out:
                yield _batch(out, _ROWS)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[Transducer]] = defaultdict(list)
        known: dict[str, dict[bytes, int]] = defaultdict(dict)
        for batch in batches:
            for kind, lang, data in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                made = Transducer.load(data.as_py())
                if kind.as_py() == 0:
                    found[lang.as_py()].append(made)
                else:
                    known[lang.as_py()].update(made.grams())
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("k", pa.int32()), ("a", pa.int64()), ("l", pa.int64()), ("r", pa.int64())])
        for lang, parts in found.items():
            weight, out = known[lang], []
            for made in parts:
                for gram, a in made.grams():
                    size = gram.count(b" ") + 1
                    out += [(lang, gram.decode(), size, k, a, weight[x], weight[y]) for k, (x, y) in enumerate(_parts(gram), 1)]
            for lo in range(0, len(out), 10_000):
                yield _batch(out[lo:lo + 10_000], schema)

    cut = rows.mapInArrow(shards, _ROWS_DDL)
    united = materialize(cut.repartitionById(ranges, "at").mapInArrow(unite, _ROWS_DDL), "phrase-ranges")
    asked = united.filter("kind < 2").repartitionById(ranges, "at").sortWithinPartitions("kind")
    answers = asked.mapInArrow(answer, _ROWS_DDL)
    both = answers.union(united.filter("kind = 0"))
    cuts = both.repartitionById(ranges, "home").mapInArrow(resolve, "lang string, phrase string, size int, k int, a long, l long, r long")
    totals = united.filter("kind = 2").groupBy("lang").agg(F.sum(F.col("data").cast("string").cast("long")).alias("n"))
    return cuts, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", limit: int | None = LIMIT, min_count: int = MIN_COUNT, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases that stay; the first `limit` of each language, or all (None)."""
    cuts, totals = count_phrases(docs, text, lang, min_count)
    score = F.expr(f"CAST((CAST(a AS DECIMAL(38, 0)) * {SCALE}) DIV (CAST(l AS DECIMAL(38, 0)) + r) AS BIGINT)")
    # each candidate's cuts are made by one task, side by side; grouping them keeps it so
    lowest = cuts.groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    found = materialize(lowest.select("lang", "phrase", "size", "a", "cut.score", "cut.l", "cut.r"), "phrase-candidates")
    words = F.split("phrase", " ")

    def inner(m: int) -> Column:
        """The phrases of m words inside a longer one."""
        runs = F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.col("w"), i, m), " "))
        return F.when(F.col("size") > m, runs).otherwise(F.array().cast("array<string>"))

    subs = F.flatten(F.array(*map(inner, range(2, LONGEST))))
    longer = found.filter("size > 2").select("lang", "a", "size", words.alias("w")).select("lang", "a", F.explode(subs).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = found.join(longer, ["lang", "phrase"], "left").filter(f"most IS NULL OR CAST(most AS DECIMAL(38, 0)) * 100 < CAST(a AS DECIMAL(38, 0)) * {inside}")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    by_lang = Window.partitionBy("lang").orderBy(*order)
    if limit is not None:
        # the first of each of some parts of a language, so that no task ranks all of one
        part = F.pmod(F.xxhash64("phrase"), F.lit(64))
        kept = kept.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= limit)
    ranked = kept.withColumn("rank", F.row_number().over(by_lang).cast("long"))
    if limit is not None:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sized AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS d FROM worded),
placed AS (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM sized),
counted AS (SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counted WHERE d = 1 GROUP BY lang),
candidates AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE d >= 2 AND f >= 30),
cuts AS (SELECT lang, d, phrase, a, w, unnest(range(1, d)) AS k FROM candidates),
parts AS (SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM cuts),
scored AS (
  SELECT p.lang, p.phrase, p.a, p.k, x.f AS l, y.f AS r, (CAST(p.a AS HUGEINT) * 2000000) // (CAST(x.f AS HUGEINT) + y.f) AS score
  FROM parts p JOIN counted x ON x.lang = p.lang AND x.phrase = p.first JOIN counted y ON y.lang = p.lang AND y.phrase = p.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sub_sizes AS (SELECT lang, a, d, w, unnest(range(2, d)) AS m FROM candidates WHERE d > 2),
sub_places AS (SELECT lang, a, w, m, unnest(range(1, d - m + 2)) AS i FROM sub_sizes),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS most FROM sub_places GROUP BY ALL),
kept AS (
  SELECT c.* FROM lowest c LEFT JOIN longer USING (lang, phrase)
  WHERE most IS NULL OR CAST(most AS HUGEINT) * 100 < CAST(c.a AS HUGEINT) * 80),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
