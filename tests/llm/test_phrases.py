"""Count transducers against dictionaries, and phrase collocations against brute force."""

import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
from conftest import SF001

from tabrisk.llm import phrases
from tabrisk.llm.transducers import Transducer


def as_dict(t):
    return {tuple(g.split(b" ")): w for g, w in t.grams()}


def random_shard(rng, n, words):
    words = rng.sample(words, len(words))
    tokens = np.array([rng.randrange(-1, len(words)) for _ in range(n)], np.int64)
    counts = Counter()
    for i in range(n):
        for d in range(1, 5):
            g = tokens[i:i + d]
            if len(g) == d and (g >= 0).all():
                counts[tuple(words[x] for x in g)] += 1
    return Transducer.of_tokens(tokens, words, 4), counts


def test_transducers():
    rng = random.Random(1)
    for _ in range(150):
        words = [b"a", b"b", b"c\x01", b"c", "é".encode()][:rng.randrange(1, 6)]
        shards = [random_shard(rng, rng.randrange(60), words) for _ in range(rng.randrange(1, 4))]
        total = sum((c for _, c in shards), Counter())
        whole = Transducer.union([t for t, _ in shards])
        assert all(as_dict(t) == as_dict(Transducer.load(t.dump())) == c for t, c in shards) and as_dict(whole) == total
        bounds = sorted({tuple(rng.choice([*words, b"bb", b"0", b"zz"]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(5))})
        for k, part in enumerate(whole.cut(bounds)):
            want = {g: w for g, w in total.items() if bisect_right(bounds, g) == k}
            assert as_dict(part) == as_dict(Transducer.union([t.cut(bounds)[k] for t, _ in shards])) == want
            assert as_dict(Transducer.load(part.pruned(3).dump())) == {g: w for g, w in want.items() if w >= 3}
        asked = sorted({tuple(rng.choice([*words, b"q"]) for _ in range(rng.randrange(1, 5))) for _ in range(8)})
        acceptor = Transducer.of_grams(asked, 4)
        assert as_dict(acceptor) == dict.fromkeys(asked, 1)
        assert as_dict(acceptor.composed(whole)) == {g: total[g] for g in asked if total[g]}


def test_weights_beyond_doubles():
    t = Transducer.of_grams([(b"a",), (b"a", b"b")], 4)
    big = Transducer(t.words, [(p, x, w * ((1 << 53) + 1)) for p, x, w in t.levels])
    assert as_dict(Transducer.union([big, t])) == {(b"a",): (1 << 53) + 2, (b"a", b"b"): (1 << 53) + 2}


def brute(rows, least, limit=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for d in range(1, 5):
                f[lang].update(tuple(w[i:i + d]) for i in range(len(w) - d + 1))
    out = []
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        most = Counter()
        for g, a in cand.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g):
                        most[g[i:j]] = max(most[g[i:j]], a)
        found = []
        for g, a in cand.items():
            if 100 * most[g] >= 80 * a:
                continue
            score, k = min((int(Fraction(2_000_000 * a, counts[g[:k]] + counts[g[k:]])), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made():
    rng = random.Random(2)
    words = ["a", "B", "the", "é", "x\x1cy", "New", "york", "city", "\x85", "q\xa0r"]
    rows = [(None, "en"), ("", None), (" \t. ,", "en"), ("a b " * 3000, "hot"), ("New York City. " * 40, "und"), ("new york\tcity,NEW york\x0bcity", None), ("the end", "")]
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ",", "\r"]) for _ in range(rng.randrange(40)))
        rows.append((text, rng.choice(["en", "en", "hot", None, "é"])))
    return rows + rows[20:40]


def test_collocations_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_WORDS", 200)  # ranges cut inside frequent prefixes
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rows = made()
    df = spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, rank int, phrase string").repartition(5)
    for least, limit in ((3, 2000), (8, 5)):
        got = phrases.collocations(df, min_count=least, limit=limit)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, least, limit)
    assert len(brute(rows, 3)) > 300 and len(phrases.range_bounds(phrases._rows(df, "text", "lang"))) > 20
    assert sorted(map(tuple, phrases.collocations(df, min_count=3, limit=None).collect())) == brute(rows, 3, 10**9)
    assert phrases.op12(df.limit(0)).count() == 0


def test_query_matches_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = sorted(map(tuple, phrases.op12(docs).collect()))
    assert got == brute([(r["text"], r["lang"]) for r in docs.collect()], 30) and got
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    assert got == sorted(con.execute(phrases.ORACLE).fetchall())
