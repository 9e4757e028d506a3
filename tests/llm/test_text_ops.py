"""Quality rules, SimHash, token counts and the BPE tree against brute force."""

import hashlib
import re
from collections import Counter
from itertools import combinations

import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import SF001

from tabrisk.llm import bpe_tree, quality_rules, simhash, token_counts
from tabrisk.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "a", "a b", "x " * 50, "é" * 3000, "\x85a\x1cb c  d\t\te\n\n f ", "<|endoftext|> a <|endoftext|>b",
       "it's  we'll\n\n\n  x" * 900, "word " * 9000, "　　全角 文字" * 2000, "a" * 20000, " " * 9000 + "z", "日本語" * 3000,
       "one two three four five six seven eight nine ten\n" * 4, "🙂🙂 🙂" * 1500]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, f"s{i % 3}" if i % 4 else None, "clash", i) for i, t in enumerate(ODD)] + [(3, "a", "s0", "clash", 3), (None, "a b c d", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, n_tokens int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_bpe_tree_matches_library_and_round_trips(spark, odd, docs):
    ranks = bpe_tree.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for df in (odd, docs):
        want = Counter()
        for k, t in texts(df):
            ids = whole.encode_ordinary(t or "")
            raw = b"".join(i.to_bytes(4, "little") for i in ids)
            want[(k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
        assert Counter(tuple(r) for r in bpe_tree.op10(spark, df).collect()) == want


@pytest.mark.parametrize("leaf", [1, 3, 17, 100])
def test_bpe_tree_joins_at_any_cut(leaf):
    ranks = bpe_tree.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    c = bpe_tree.TreeBpe(ranks, public_tokenizers.PATTERN, leaf)
    for t in ODD:
        t = (t or "")[:700]
        ids = c.encode(t)
        assert ids.tolist() == c.encoding.encode_ordinary(t)
        assert c.decode(ids) == t.encode()


def test_bpe_ids_column_and_empty_table(spark, odd):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = bpe_tree.encode_decode(odd, path, public_tokenizers.PATTERN, with_ids=True)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out.collect())
    assert bpe_tree.op10(spark, odd.limit(0)).count() == 0


def test_token_counts_match_library(spark, odd, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd, docs):
        want = Counter()
        for k, t in texts(df):
            n = len(tok.encode(t or "", add_special_tokens=False))
            want[(k, len((t or "").encode()), n, n > 512)] += 1
        assert Counter(tuple(r) for r in token_counts.op4(spark, df).collect()) == want


def test_token_cache_is_appended_once(spark, odd, docs):
    path, tok = scratch_path(spark, "test-cache"), public_tokenizers.path("byte_bpe_50k.json")
    first = token_counts.token_counts(odd, path, tok)
    assert "text" not in first.columns and "n_words" in first.columns
    n = token_counts.read_cache(spark, path).count()
    assert n == len({t or "" for _, t in texts(odd)})
    token_counts.fill_cache(odd, path, tok)
    assert token_counts.read_cache(spark, path).count() == n
    token_counts.fill_cache(docs, path, tok)
    assert token_counts.read_cache(spark, path).count() == len({t or "" for _, t in texts(odd)} | {t for _, t in texts(docs)})
    assert token_counts.op4(spark, odd.limit(0)).count() == 0


def rule_row(k, t):
    ws = WORD.findall(t or "")
    ls = [x for x in (t or "").split("\n") if WORD.search(x)]
    c = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    marked = {p for i in range(len(ws) - 4) if c[tuple(ws[i : i + 5])] > 1 for p in range(i, i + 5)}
    base = len(ws) < 10 or 100 * len(marked) > 20 * len(ws)
    chars, symbols = sum(map(len, ws)), sum(x in "#*$%&|<>" for x in t or "")
    upper, dup = sum("A" <= x <= "Z" for x in t or ""), len(ls) - len(set(ls))
    kept = not (base or 10 * symbols > len(ws) or 2 * upper > chars or 2 * dup > len(ls) or chars > 20 * len(ws))
    return (k, len(ws), chars, symbols, dup, len(marked), base, kept)


def test_quality_rules(odd, docs):
    for df in (odd, docs, odd.limit(0)):
        want = Counter(rule_row(k, t) for k, t in texts(df))
        assert Counter(tuple(r) for r in quality_rules.op5(df).drop("failed").collect()) == want


def test_quality_rules_ablation_and_labels(spark, docs):
    led = quality_rules.ledger(docs, keep=["doc_id"]).collect()
    mask, got = quality_rules.policy_mask("v1"), {r["rule"]: (r["n_failed"], r["n_only_this"]) for r in quality_rules.ablations(quality_rules.ledger(docs, keep=["doc_id"])).collect()}
    for rule in quality_rules.POLICIES["v1"]:
        bit = quality_rules.rule_bit(rule)
        assert got.get(rule, (0, 0)) == (sum(bool(r["failed"] & bit) for r in led), sum(r["failed"] & mask == bit for r in led))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    kept = {r["doc_id"]: (r["kept"], r["n_words"]) for r in quality_rules.op5(docs).collect()}
    clean = [kept[k][0] for k, q in labels.items() if q == 1 and kept[k][1] >= 10]
    assert sum(clean) >= 0.99 * len(clean)


def test_keep_good_keeps_columns(odd):
    out = quality_rules.keep_good(odd)
    assert out.columns == odd.columns
    assert out.count() == sum(rule_row(*x)[-1] for x in texts(odd))


def fp_of(t):
    ws = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    sh = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def simhash_want(rows, distance=3):
    fps = [(k, fp_of(t)) for k, t in rows]
    distinct = sorted({f for _, f in fps})
    links = [(a, b) for a, b in combinations(distinct, 2) if bin(a ^ b).count("1") <= distance]
    of, least = classes(links, distinct), {}
    for k, f in fps:
        if k is not None:
            least[of[f]] = min(k, least.get(of[f], k))
    return Counter((k, f"{f:016x}", least.get(of[f])) for k, f in fps)


def test_simhash(odd, docs):
    for df in (odd, docs, odd.limit(0)):
        assert Counter(tuple(r) for r in simhash.op7(df).collect()) == simhash_want(texts(df))


def test_simhash_links_in_large_groups(spark, monkeypatch):
    """Chains of near fingerprints, and groups that are split again, lose no component."""
    monkeypatch.setattr(simhash, "SPLIT", 3)
    import random
    rng, fps = random.Random(5), set()
    for _ in range(8):
        at = rng.getrandbits(64)
        for _ in range(60):
            fps.add(at)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 5])):
                at ^= 1 << b
    fps |= {0, (1 << 64) - 1}
    signed = [(simhash._signed(f),) for f in sorted(fps)]
    df = spark.createDataFrame(signed, "fp long")
    from tabrisk.llm.components import components
    got = {r["node"]: r["component"] for r in components(simhash.close_links(df, 3)).collect()}
    links = [(simhash._signed(a), simhash._signed(b)) for a, b in combinations(sorted(fps), 2) if bin(a ^ b).count("1") <= 3]
    want = classes(links, [f for f, in signed])
    assert {f: got.get(f, f) for f, in signed} == want


def test_keep_one_of_each(odd):
    out = simhash.keep_one_of_each(odd.withColumn("__key", odd["doc_id"]).withColumn("fp", odd["text"]))
    assert out.columns == [*odd.columns, "__key", "fp"]
    want = {c for _, _, c in simhash_want(texts(odd))}
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(x for x in want if x is not None)
