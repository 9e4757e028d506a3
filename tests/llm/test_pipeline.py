"""Every stage of the pipeline against brute force on its own input, and mixing by its definition."""

import hashlib
import math
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from conftest import SF001
from pyspark.sql import functions as F
from test_line_dedup import expected
from test_text_ops import ODD, rule_row, simhash_want

import corpus_pipeline
from tabrisk.llm import bpe_tree, mixing
from tabrisk.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def times_by_sql(docs):
    """doc_id -> how often the mix takes the document, from the mixing query's own SQL."""
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    at = mixing.ORACLE.rindex("SELECT doc_id")
    sql = mixing.ORACLE[:at] + mixing.ORACLE[at:].replace("CAST(size * (passes + ", "CAST((passes + ")
    return {(r[0]): r[4] for r in con.execute(sql).fetchall()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = spark.createDataFrame([(10_000 + i, t, "en", "src0" if i % 2 else None, 1) for i, t in enumerate(ODD)], docs.schema)
    docs = materialize(docs.union(extra), "test")
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_tree.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF001), "test")
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        if name != "bpe":
            assert out.columns == COLUMNS and out.schema == docs.schema
        if name == "quality_rules":
            assert Counter(after) == Counter(r for r in before if rule_row(r[0], r[1])[-1])
        elif name == "line_dedup":
            want = {k: h for (k, _, _, h) in expected([r[:2] for r in before], spark)}
            assert {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in after} == want and len(after) == len(before)
            assert Counter(r[0::2] for r in after) != Counter() and all(r[4] == len(r[1]) for r in after if r[1] is not None)
        elif name == "simhash":
            stay = {k for (k, _, c) in simhash_want([r[:2] for r in before]) if k == c}
            assert Counter(after) == Counter(r for r in before if r[0] in stay)
        elif name == "mixing":
            times = times_by_sql(docs)
            assert Counter(after) == Counter({r: times[r[0]] for r in before if times[r[0]]})
        else:
            want = Counter()
            for r in before:
                ids = enc.encode_ordinary(r[1] or "")
                want[(r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
            assert Counter(after) == want
        docs = out


def test_run_and_empty_table(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF001), "test")
    assert docs.count() == 0


@pytest.fixture(scope="module")
def sourced(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), ["b", "a", None, "ä", "zz", ""][0 if i % 3 else i % 6]) for i in range(4000)]
    rows += [(5, "again again", "a"), (None, "x y", "b"), (6, None, "zz"), (9001, "", "empty")]
    return spark.createDataFrame([(*r, 1, "q") for r in rows], "doc_id long, text string, source string, size int, shard string")


def test_mix_meets_targets(sourced):
    out = mixing.op1(sourced)
    rows = out.collect()
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, rows)) and len(rows) == sourced.count()
    con = duckdb.connect()
    con.register("documents", sourced.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    assert Counter(tuple(r) for r in rows) == Counter(con.execute(mixing.ORACLE).fetchall())
    got, target, size = defaultdict(int), {}, {}
    for r in mixing.mix(sourced, keep=["source"]).collect():
        got[r["source"]] += r["size"] * len(r["draws"])
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert len(r["draws"]) <= 3
    for s, t in target.items():
        assert t <= 3 * size[s] and abs(got[s] - t) <= 400, s
    pairs = {(r["source_size"], r["target"]) for r in rows}
    assert math.isclose(sum(t for _, t in pairs), sum(n for n, _ in pairs))


def test_targets_hold_for_missing_and_repeated_ids(spark):
    rows = [(None if s == "a" else 57, f"word {i} " * (5 + i % 40), s) for s in "ab" for i in range(900)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), keep=["source"])
    got, target = defaultdict(int), {}
    for r in found.collect():
        got[r["source"]] += r["size"] * len(r["draws"])
        target[r["source"]] = r["target"]
    assert all(abs(got[s] - target[s]) <= 200 for s in "ab"), (got, target)  # within a cell of a few documents


def test_shards_hold_exact_disjoint_quotas(spark, sourced):
    found = mixing.mix(sourced, depth=4).select("doc_id", F.size("draws").alias("n"), F.explode("draws").alias("d")).select("doc_id", "n", "d.*").collect()
    assert {r["shard"] for r in found} == set(range(16))
    assert len({(r["doc_id"], r["pass"]) for r in found if r["doc_id"] not in (5, 6, None)}) == sum(r["doc_id"] not in (5, 6, None) for r in found)


def test_splitting_tree_is_hypergeometric(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 100), ("c", 0), ("d", 7)], "source_key string, quota long")
    first = []
    for seed in range(40):
        rows = mixing.split_quotas(quotas, 1, seed).collect()
        by = {(r["source_key"], r["shard"]): r["quota"] for r in rows}
        for k, q in (("a", 40), ("b", 100), ("c", 0), ("d", 7)):
            assert by[k, 0] + by[k, 1] == q and min(by[k, 0], by[k, 1]) >= 0
        assert sum(by[k, 0] for k in "abcd") == 73
        first.append(by["a", 0])
    mean = sum(first) / len(first)
    spread = sum((x - mean) ** 2 for x in first) / (len(first) - 1)
    # expected 40 * 73/147, variance 73 * (40/147) * (107/147) * (74/146)
    assert abs(mean - 19.86) < 1.6 and 3 < spread < 21


def test_weights_and_caps(spark):
    sizes = spark.createDataFrame([("s1", "a", 1000), ("s2", "b", 10), ("s3", "c", 100), ("n", None, 5)], "source_key string, source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == (2, 30.0) and got["c"] == (3, 300.0) and got[None] == (1, 15.0) and got["a"] == (1, 770.0)
