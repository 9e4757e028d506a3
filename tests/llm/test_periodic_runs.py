"""Periodic runs against a brute-force reading of the definition."""

import hashlib
import random
import re
import zlib
from collections import Counter

from conftest import SF001

from tabrisk.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(x == y for x, y in zip(w, w[q:], strict=False)))


def brute(w):
    """(start, length, period) of all runs, from every lag's stretches of agreement."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q) and smallest_period(w[i:j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = (None,) * 4
    for s, m, q in runs:
        if best[0] is None or m * best[2] > best[1] * q:
            best = (s, m, q, 1000 * m // q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def odd_texts():
    rng, out = random.Random(5), [None, "", " \n", "a", "a " * 23, "a " * 24, "x\x1cy " * 40, "é\x85b c\t" * 30, "1 2 3 4 5 6 7 8 " * 3, "1 2 3 4 5 6 7 8 9 " * 3 + "1", "a b " * 12 + "a a " * 12]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            block = [rng.choice("abc" if rng.random() < 0.6 else "ab") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 30, 33, 40, 64, 65]))]
            parts += block * rng.randrange(1, 6) + block[:rng.randrange(len(block))] + [rng.choice("abcd") for _ in range(rng.randrange(6))]
        out.append(" ".join(parts))
    # a period whose own 16-grams all occur twice inside it
    inner = [rng.choice("ab") for _ in range(40)]
    out.append(" ".join((inner * 2 + ["c"] + inner * 2 + ["d"]) * 4))
    return out


def test_definition(spark):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    rows = list(enumerate(odd_texts())) + [(3, "a"), (3, "a"), (None, "a b c " * 9), (None, None)] + real
    df = spark.createDataFrame([(k, t, "x", 1, 2.0) for k, t in rows], "doc_id long, text string, runs string, _1 int, row double")
    got = Counter(tuple(r) for r in periodic_runs.op11(df).collect())
    assert got == Counter(expected(k, t) for k, t in rows)
    assert sum(r[1] > 0 for r in got) > 100
    assert periodic_runs.op11(df.limit(0)).count() == 0


def test_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 20, "x", 7)], "id long, body string, runs string, `p.q` int")
    row = periodic_runs.periodic_runs(df, "body").first()
    assert row.asDict(recursive=True) == {"id": 1, "body": "a b " * 20, "p.q": 7, "n_words": 40, "runs": [{"start": 0, "length": 40, "period": 2}], "collapsed": "a b"}


def test_long_texts():
    """Pairs stay linear: a word, and a long period, repeated over hundreds of thousands of words."""
    assert periodic_runs.runs_of_text("a " * 300_000)[1] == [(0, 300_000, 1)]
    rng = random.Random(1)
    block = [rng.choice("ab") for _ in range(50_000)]
    runs = periodic_runs.runs_of_text(" ".join(block * 4))[1]
    assert (0, 200_000, 50_000) in runs
