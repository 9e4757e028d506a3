"""Lattice hashing against brute-force cosine."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF01

from tabrisk.llm import lattice


def brute(rows, least=0.9):
    good = []
    for i, (_, v) in enumerate(rows):
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, dtype=np.float32).astype(float)
            x = x / np.abs(x).max()
            good.append((i, x / np.linalg.norm(x)))
    links = np.zeros(len(rows), dtype=int)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for n, (i, x) in enumerate(good):
        for j, y in good[n + 1:]:
            if len(x) == len(y) and x @ y >= least:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least_of = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least_of[root(i)] = min(k, least_of.get(root(i), k))
    return Counter((k, int(links[i]), least_of.get(root(i)), k == least_of.get(root(i))) for i, (k, _) in enumerate(rows))


def test_decoder_finds_nearest_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.nearest_e8(x)
    twice = 2 * p
    assert np.array_equal(twice, np.rint(twice))
    whole = (p == np.rint(p)).all(axis=1) | (p != np.rint(p)).all(axis=1)
    assert whole.all() and (p.sum(axis=1) % 2 == 0).all()
    d = ((x - p) ** 2).sum(axis=1)
    assert all((d <= ((x - p - n) ** 2).sum(axis=1) + 1e-9).all() for n in lattice.NEIGHBOURS)
    assert len(np.unique(lattice.NEIGHBOURS, axis=0)) == 240


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [float("nan"), 1.0]),
            (9, [float("inf"), 1.0]), (10, [0.0, 1.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (None, [0.0, 3.0]), (None, [5.0, 5.0, 5.0, 5.0]), (13, [1e30, 1e30]), (14, [1e-30, 1e-30]), (0, [1e-30, 1e-30])]
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, label int, codes string")
    assert Counter(tuple(r) for r in lattice.op6(df).collect()) == brute(rows)
    assert lattice.op6(df.limit(0)).count() == 0


def test_large_cell_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 7)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 16))
    rows = [(i, (centres[i % 4] + 0.02 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(0, 40, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert Counter(tuple(r) for r in lattice.op6(df).collect()) == brute(rows)


@pytest.mark.parametrize("cosine", [0.9005, 0.95])
def test_recall_near_the_threshold(spark, cosine):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = lattice.op6(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    found = sum(r["n_links"] for r in got) / 2
    assert found >= 0.93 * 1500 and max(r["n_links"] for r in got) == 1


def test_links_of_the_table(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, got = brute(rows), Counter(tuple(r) for r in lattice.op6(df).collect())
    assert sum(n for (_, n, _, _) in got) >= 0.99 * sum(n for (_, n, _, _) in want)
    assert sum((want & got).values()) >= 0.99 * len(rows)
