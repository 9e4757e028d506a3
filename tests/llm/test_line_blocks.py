"""Line dedup against all earlier documents, not only the first holder of a line."""

import random

from pyspark.sql import functions as F

from tabrisk.llm import line_dedup

P, Q = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")


def kept(spark, texts, min_words=5):
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    return [r["text"] for r in line_dedup.dedup_lines(df, min_words=min_words).orderBy("doc_id").collect()]


def test_block_of_two_later_documents_with_crossing_passages(spark):
    assert kept(spark, [f"{P}\nx1\n{Q}", f"x2\n{Q}", f"{Q}\nx3\n{P}"]) == [f"{P}\nx1\n{Q}", "x2", "x3"]
    assert kept(spark, [f"{P}\nx1\n{Q}", f"{Q}\nx3\n{P}"])[1] == "x3"


def test_block_of_short_lines_that_others_hold_singly(spark):
    block = "a b\nc d\ne f"
    assert kept(spark, ["a b\nown 1", "c d\nown 2", "e f\nown 3", block, f"{block}\nown 5"]) == ["a b\nown 1", "c d\nown 2", "e f\nown 3", block, "own 5"]


def test_every_common_block_of_any_two_documents(spark):
    rng = random.Random(11)
    pool = ["a", "b", "c d", "e f g", "h i j k", "l m n o p", "q r s t u v"]
    texts = ["\n".join(rng.choice([*pool, f"own {k}", ""]) for _ in range(rng.randrange(12))) for k in range(70)]
    lines = [[x for x in t.split("\n") if x] for t in texts]
    for least in (1, 5, 9):
        want = []
        for k, b in enumerate(lines):
            runs = {tuple(a[i:j]) for a in lines[:k] for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
            gone = {n for i in range(len(b)) for j in range(i + 1, len(b) + 1) if tuple(b[i:j]) in runs and len(" ".join(b[i:j]).split()) >= least for n in range(i, j)}
            want.append(gone)
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r["id"]: r for r in line_dedup.lost_lines(df, min_words=least).collect()}
        assert [found[k]["gone"] if k in found else [] for k in range(len(texts))] == [sorted(x) for x in want]
        for k, row in found.items():
            # every block is a run of lines of an earlier document, and the blocks are what goes
            for x in row["blocks"]:
                run = lines[k][x["start"]:x["stop"]]
                assert x["earlier"] < k and run == lines[x["earlier"]][x["there"]:x["there"] + len(run)] and len(" ".join(run).split()) >= least
            assert {n for x in row["blocks"] for n in range(x["start"], x["stop"])} == want[k]


def test_copies_pair_with_the_first_one(spark):
    texts = ["\n".join(f"passage {i} has quite some words" for i in range(6))] * 400 + ["own line of some more words\npassage 3 has quite some words"] * 2
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = line_dedup.lost_lines(df).collect()
    assert sum(len(r["blocks"]) for r in rows) == 399 + 1 + 2  # a whole copy is one block of one pair
    assert {x["earlier"] for r in rows for x in r["blocks"]} == {0, 400}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(df).filter(F.lit(True)).count() == 0
