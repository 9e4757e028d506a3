"""Toxicity: subwords and scores by brute force, held-out accuracy, unseen misspellings, odd rows."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tabrisk.llm import toxicity

SF1 = "/root/testdata/sf0.1"


def test_subwords_are_the_grams_of_marked_words():
    words = ["a", "ab", "idiot", "é🙂x", "x" * 40, "aaaaaaa", "aaaaaab"]
    number, bucket = toxicity.subwords(words)
    alone = {}
    for k, w in enumerate(words):
        got = sorted(bucket[number == k].tolist())
        assert got == sorted(toxicity.subwords([w])[1].tolist())  # neighbours change nothing
        marked = f"<{w}>"
        assert len(got) == 1 + sum(max(0, len(marked) - n + 1) for n in toxicity.SIZES)
        alone[w] = set(got)
    assert len(alone["aaaaaaa"] & alone["aaaaaab"]) >= 4 and not alone["idiot"] & alone["ab"]


def test_score_is_that_of_the_worst_words(spark):
    rng = np.random.default_rng(1)
    model = rng.normal(0, 3, toxicity.BUCKETS), -2.0
    texts = [None, "", " \n", "One two one", "b\x1cc " + " ".join(f"w{i}" for i in range(300)), "x" * 5000]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, _1 int")
    for r in toxicity.score(df, model).collect():
        logits = []
        for w in {x.decode() for x in (r["text"] or "").lower().encode().split()}:
            logits.append(model[0][toxicity.subwords([w])[1]].mean() + model[1])
        clean = math.prod(1 / (1 + math.exp(x)) for x in sorted(logits)[-toxicity.TOP:])
        assert abs(r["score"] - (1 - clean)) < 1e-9 and r["predicted"] == (r["score"] >= 0.5) and r["_1"] == 1


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF1}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = toxicity.op13(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    got = [(known[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in known]
    toxic, clean = [p for t, p in got if t == 1], [p for t, p in got if t == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)  # some toxic rows hold no toxic word at all


def made(n=1500):
    rng = random.Random(4)
    plain = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    rows = []
    for k in range(n):
        bad = k % 6 == 0
        ws = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["worthless", "pathetic", "Idiot!"]))
        rows.append((k, " ".join(ws), int(bad)))
    return rows, plain


def test_misspellings_length_and_reruns(spark):
    rows, plain = made()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, None), (None, 1), (99_999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(5), labels.repartition(3))
    assert (model[0] == again[0]).all() and model[1] == again[1]
    tests = [(1, "worthles"), (2, "w0rthless"), (3, "pathetik"), (4, "idiots"), (5, " ".join(plain * 50)), (6, plain[3]), (7, " ".join(plain * 50) + " worthlesss")]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 1}


def test_sample_bound_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"text {i % 300}") for i in range(900)] + [(k, "other") for k in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 60)], "doc_id long, toxic int")
    sample = toxicity.training_rows(docs, labels, "text", "doc_id", "toxic", 50)
    assert sample.count() == 50
    assert toxicity.training_rows(docs, labels, "text", "doc_id", "toxic", 10_000).count() == 300 + 58


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.op13(docs, none)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {(r["score"], r["predicted"]) for r in out.collect()} == {(0.0, 0)} and out.count() == 4
    assert toxicity.op13(docs.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.op13(docs, one).collect())
    assert [r["held_out"] for r in out.filter(F.col("doc_id").isNull()).collect()] == [False]
