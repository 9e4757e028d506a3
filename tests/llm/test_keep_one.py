"""One row of each component stays, whatever the ids are."""

from collections import Counter

from tabrisk.llm import simhash

A, B, C, D = (" ".join(f"{c}{i * i}" for i in range(40)) for c in "abcd")


def test_rows_without_or_with_repeated_ids(spark):
    # 1 holds A and B; C has no id; D has none in its first copy
    rows = [(1, A, "x"), (1, B, "x"), (2, A, "y"), (None, C, "x"), (None, C, "x"), (None, D, "x"), (5, D, "z"), (7, "", "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter([(1, A, "x"), (1, B, "x"), (None, C, "x"), (5, D, "z"), (7, "", "x")])
    for _ in range(2):
        assert Counter(tuple(r) for r in simhash.keep_one_of_each(df).collect()) == want


def test_equal_texts_of_one_id_in_different_rows_leave_one(spark):
    df = spark.createDataFrame([(None, C, s, {"k": s}) for s in "uvwxyzz"], "doc_id long, text string, source string, tags map<string,string>")
    out = [simhash.keep_one_of_each(df.repartition(n)).select("doc_id", "text", "source").collect() for n in (1, 4)]
    assert len(out[0]) == 1 and out[0] == out[1]
