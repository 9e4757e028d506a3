"""Weak-label model: estimation, held-out accuracy, odd rows."""

import re

import numpy as np
from conftest import SF001, SF01
from pyspark.sql import functions as F

from tabrisk.llm import quality_model


def test_estimation_recovers_labellers():
    rng = np.random.default_rng(3)
    n, m = 60_000, len(quality_model.LABELLERS)
    good = rng.random(n) < 0.7
    right = np.linspace(0.65, 0.95, m)
    vote = np.where(rng.random((n, m)) < right, good[:, None], ~good[:, None])
    vote = np.where(rng.random((n, m)) < 0.6, np.where(vote, quality_model.GOOD, quality_model.BAD), quality_model.NONE)
    codes, counts = np.unique(vote @ 3 ** np.arange(m), return_counts=True)
    post, table, share = quality_model.estimate(codes, counts.astype(float))
    assert abs(share - 0.7) < 0.02
    said = table[1, :, quality_model.GOOD] / (table[1, :, quality_model.GOOD] + table[1, :, quality_model.BAD])
    assert np.abs(said - right).max() < 0.03


def test_accuracy_on_labels_it_has_not_seen(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    out = quality_model.op2(docs).collect()
    assert len(out) == docs.count()
    long = {r["doc_id"] for r in docs.selectExpr("doc_id", "size(split(text, ' ')) n").filter("n >= 10").collect()}
    got = [(labels[r["doc_id"]], r["kept"]) for r in out if r["doc_id"] in labels and r["doc_id"] in long]
    good, bad = [k for q, k in got if q == 1], [k for q, k in got if q == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(not k for k in bad) >= 0.9 * len(bad)


def test_odd_rows(spark):
    rows = [(1, None, 1.0), (2, "", 1.0), (3, " \n", None), (4, "the end of it is that " * 3000, 2.0), (4, "the end of it is that " * 3000, 2.0), (None, "x", 0.0), (5, "$$$ ### " * 50, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = quality_model.op2(df)
    assert out.columns == ["doc_id", "score", "kept"] and out.count() == len(rows)
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert len({r["score"] for r in out.filter("doc_id = 4").collect()}) == 1
    assert quality_model.op2(df.limit(0)).count() == 0


def brute_votes(t):
    """The votes on a text by a plain reading of the labellers, as -1, 0 or 1 for each in order."""
    ws = [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n, chars = len(ws), sum(map(len, re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    symbols, upper = sum(c in "#*$%&|<>" for c in t or ""), sum("A" <= c <= "Z" for c in t or "")
    dup, echo, distinct = len(lines) - len(set(lines)), sum(a == b for a, b in zip(ws, ws[1:], strict=False)), len(set(ws))
    stop = sum(w in quality_model.STOP_WORDS for w in ws)
    rules = [(n == 0, n >= 50), (10 * symbols > n, n >= 10 and 100 * symbols <= n), (10 * upper > 3 * chars and n >= 10, 10 * upper < chars and n >= 10),
             (5 * dup > 2 * len(lines) and len(lines) >= 3, dup == 0 and len(lines) >= 2), (10 * echo > n and n >= 10, 50 * echo < n and n >= 20),
             (20 <= n <= 2000 and 4 * distinct < n, n >= 20 and 5 * distinct > 2 * n), (n >= 20 and 50 * stop < n, n >= 10 and 10 * stop >= n),
             (n >= 10 and (chars < 3 * n or 2 * chars > 15 * n), n >= 10 and 4 * n <= chars and 10 * chars <= 65 * n)]
    return [-1 if bad else 1 if good else 0 for bad, good in rules]


def brute_posterior(votes, rounds=200):
    """Expectation-maximisation document by document."""
    post = [(sum(v == 1 for v in row) + 1) / (sum(v == 1 for v in row) + 3 * sum(v == -1 for v in row) + 2) for row in votes]
    for _ in range(rounds):
        share = (sum(post) + 1) / (len(post) + 2)
        good, bad = ([[sum(p for p, row in zip(w, votes, strict=True) if row[k] == v) + 0.5 for v in (1, -1)] for k in range(len(votes[0]))] for w in (post, [1 - p for p in post]))
        new = []
        for row in votes:
            a, b = share, 1 - share
            for k, v in enumerate(row):
                if v:
                    at = 0 if v == 1 else 1
                    a, b = a * good[k][at] / sum(good[k]), b * bad[k][at] / sum(bad[k])
            new.append(a / (a + b))
        if max(abs(x - y) for x, y in zip(post, new, strict=True)) < 1e-12:
            break
        post = new
    return post


def test_posteriors_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    _, posterior = quality_model.fit(docs)
    got = {r["doc_id"]: r["score"] for r in quality_model.score_by_votes(docs, posterior).collect()}
    want = brute_posterior([brute_votes(r["text"]) for r in rows])
    assert all(abs(got[r["doc_id"]] - p) < 1e-4 for r, p in zip(rows, want, strict=True))


def test_equal_and_missing_ids(spark):
    rows = spark.read.parquet(f"{SF001}/documents.parquet").select("text").collect()
    for key in (57, None):
        df = spark.createDataFrame([(key, r["text"]) for r in rows], "doc_id long, text string")
        model, _ = quality_model.fit(df, train_rows=100)
        out = quality_model.op2(df).collect()
        assert model is not None and all(r["score"] is not None for r in out) and any(r["kept"] for r in out)


def test_scores_by_votes_without_a_sample(spark):
    df = spark.createDataFrame([(i, "the end of it is that we are in the house on the hill") for i in range(400)], "doc_id long, text string")
    out = [quality_model.fit(df.withColumn("text", F.concat("text", F.lit(f" {k}"))).withColumn("doc_id", F.lit(1)), train_rows=1)[0] for k in range(2)]
    assert None in out
    scores = quality_model.score_by_votes(df, quality_model.fit(df)[1]).collect()
    assert len(scores) == 400 and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in scores)
