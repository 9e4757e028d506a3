"""Line dedup against a brute-force reading of its definition."""

import difflib
import hashlib
import random
import re
from collections import Counter

import pytest
from conftest import SF001

from tabrisk.llm import line_dedup

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs(ls, least=5):
    """(first, after last) of the shortest runs of `least` words from each line on and up to each line."""
    n = [len(WORD.findall(x)) for x in ls]
    out = set()
    for i in range(len(ls)):
        on = next((j for j in range(i + 1, len(ls) + 1) if sum(n[i:j]) >= least), None)
        back = next((j for j in range(i, -1, -1) if sum(n[j:i + 1]) >= least), None)
        out |= {(i, on)} if on is not None else set()
        out |= {(back, i + 1)} if back is not None else set()
    return out


def expected(rows, spark):
    """doc_id and text -> what is left of the text: lines in a run of five words or more that any earlier document has go."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(k, t) for k, t in rows], "k long, t string")
    th = {(r["k"], r["t"]): r["h"] for r in df.withColumn("h", F.xxhash64(F.coalesce("t", F.lit("")))).collect()}
    docs = {}
    for k, t in rows:
        docs[(k is not None, k or 0, th[(k, t)])] = (k, t)
    seen, out = set(), {}
    for d in sorted(docs):
        k, t = docs[d]
        ls = [x.strip(WS) for x in (t or "").split("\n") if x.strip(WS)]
        mine = runs(ls)
        gone = {n for i, j in mine if tuple(ls[i:j]) in seen for n in range(i, j)}
        seen |= {tuple(ls[i:j]) for i, j in mine}
        at, kept = -1, []
        for x in (t or "").split("\n"):
            at += bool(x.strip(WS))
            if not x.strip(WS) or at not in gone:
                kept.append(x)
        out[(k, t)] = (len(ls), len(gone), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return Counter((k, *out[(k, t)]) for k, t in rows)


@pytest.fixture(scope="module")
def made(spark):
    rng, rows = random.Random(3), []
    pool = [f"line {i} with {'several ' * (i % 4)}words" for i in range(40)] + ["a", "b", " a", "one two three four five six"]
    for k in range(120):
        rows.append((k, "\n".join(rng.choice([rng.choice(pool), f"own {k} {rng.random()}", "", "  "]) for _ in range(rng.randrange(14)))))
    base = "\n".join(rng.sample(pool, 20))
    rows += [(200, base), (201, base), (201, base), (202, base + "\nmore of it here now ok"), (201, "one two three four five six"), (None, base), (None, None), (7, None), (8, ""), (203, "\n\n\n")]
    return [(k, t) for k, t in rows]


def test_matches_definition(spark, made):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for rows in (made, real, []):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = Counter(tuple(r) for r in line_dedup.op8(df).collect())
        assert got == expected(rows, spark)


def test_columns_stay(spark, made):
    df = spark.createDataFrame([(k, t, 1, "x", "y", 2) for k, t in made], "doc_id long, text string, n_chars long, pos string, __gone string, __id int")
    out = line_dedup.without_repeated_blocks(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())


def test_text_keys(spark):
    df = spark.createDataFrame([("b", "one two three four five\nx"), ("a", "y\none two three four five"), (None, "z")], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_blocks(df).collect()} == {"a": "y\none two three four five", "b": "x", None: "z"}


def test_alignment_reaches_every_shared_window():
    rng = random.Random(7)
    for _ in range(500):
        late, early = rng.sample(range(30), 20), rng.sample(range(30), 20)
        shared = [(rng.randrange(1, 4), sorted(late.pop() for _ in range(rng.randrange(1, 4))), sorted(early.pop() for _ in range(rng.randrange(1, 4)))) for _ in range(rng.randrange(1, 7))]
        blocks = line_dedup.aligned(shared)
        assert {n for i, j, _ in blocks for n in range(i, j)} == {n for size, places, _ in shared for i in places for n in range(i, i + size)}
    far = 30_000
    assert line_dedup.aligned([(1, [i], [i]) for i in range(far)]) == [(0, far, 0)]
    assert len(line_dedup.aligned([(1, [i], [far - i]) for i in range(far)])) == far
    assert line_dedup.aligned([(1, [0, 1], [5]), (1, [2], [3]), (2, [3], [6])]) == [(0, 1, 5), (1, 2, 5), (2, 3, 3), (3, 5, 6)]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = [[rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2)]
        found = line_dedup._matched(a, b, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in found)
        assert all(x < i and y < j for (x, y), (i, j) in zip(found, found[1:], strict=False))
        if a == b:
            assert len(found) == len(a)
        assert len(found) <= sum(m.size for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()) + 15
