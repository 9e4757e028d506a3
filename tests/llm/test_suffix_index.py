"""Repeated-string removal and its index against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from conftest import SF001

from tabrisk.llm import suffix_index


def brute(rows, window=200):
    raw = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    out = Counter()
    for k, b in raw:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out[(k, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß日") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(60) for _ in range(5)]
    rows = []
    for k in range(60):
        parts = [prose(rng.randrange(40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.randrange(100, 400)])
        rows.append((k, " ".join(parts)))
    rows += [(100, "ab" * 900), (101, "was " * 700), (102, "x" * 150_000), (103, rows[3][1]), (103, rows[3][1]), (104, None), (105, ""), (None, passages[0]),
             (106, passages[1][:199]), (107, "q" * 199), (108, "z" * 200), (109, "y" * 201), (110, "\0" * 300), (111, prose(30) + "\0" * 250)]
    return rows


def test_matches_brute_force(spark, made):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for rows in (made, real, []):
        df = spark.createDataFrame([(k, t, 1, "a") for k, t in rows], "doc_id long, text string, start long, t1 string")
        assert Counter(tuple(r) for r in suffix_index.op9(df).collect()) == brute(rows)


def test_large_groups_are_routed_again(spark, made, monkeypatch):
    monkeypatch.setattr(suffix_index, "LIMIT", 1500)
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_index.op9(df).collect()) == brute(made)


def test_index_on_small_strings():
    rng = random.Random(9)
    for _ in range(200):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(8, 40))).encode() for _ in range(rng.randrange(1, 6))]
        seen = Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
        got = suffix_index.repeated_windows(parts, 8)
        assert [x.tolist() for x in got] == [[seen[p[i : i + 8]] > 1 for i in range(len(p) - 7)] for p in parts]


def test_index_samples_and_order():
    rng = random.Random(2)
    text = np.frombuffer(("".join(rng.choice("abc") for _ in range(400)) * 3).encode(), dtype=np.uint8)
    raw = text.tobytes()
    sa = suffix_index.suffix_array(text, suffix_index._packed(text))
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    index = suffix_index.RunLengthIndex(text)
    assert len(index.heads) < len(raw) / 2
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(raw[a:], raw[b:], strict=False)) if x != y), len(raw) - max(a, b))
    row = {p: i for i, p in enumerate(sa.tolist())}
    want = [max(common(p, sa[i - 1]) if (i := row[p]) else 0, common(p, sa[i + 1]) if i + 1 < len(sa) else 0) for p in range(len(raw))]
    assert index.matching_statistics().tolist() == want


def test_every_window_is_in_one_piece_and_equal_windows_share_the_hash():
    rng = random.Random(5)
    part = bytes(rng.randrange(97, 100) for _ in range(700))
    data = part + bytes(rng.randrange(97, 123) for _ in range(500)) + part + b"ab" * 300
    h, start, n, _ = suffix_index.pieces(data, 20, 50)
    assert start[0] == 0 and (start[1:] == (start + n)[:-1]).all() and n.sum() == len(data) - 49
    of = np.repeat(h, n)
    where = {}
    for i in range(len(data) - 49):
        assert where.setdefault(data[i : i + 50], of[i]) == of[i]
