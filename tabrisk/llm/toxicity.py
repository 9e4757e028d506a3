"""Toxicity: bags of subword vectors, averaged into a linear softmax.

A word is the bag of its character n-grams (`SIZES` code points, with marks for its ends) and of itself, each hashed to one of
`BUCKETS` rows of an embedding table E. The average of the bag is the word's vector, and softmax(vector W + b) says whether
the word is toxic. A text is toxic if any of its words is: its probability is 1 - prod(1 - p), in training over its distinct
words, in scoring over the `TOP` most toxic ones, so that a clean text can't become toxic by being long. Only texts carry
labels; E, W and b are trained together on their cross entropy. A misspelling that was never seen shares n-grams, and so
vectors, with the word it hides. (An average over all words of a text drowns a few insults among hundreds of words.)

All below the softmax is linear, so with two classes a word's logit is the mean over its bag of one number per bucket,
E (W1 - W0). Training needs the sums of the logits' gradient per bucket only; scoring looks a word up once per task.
Rare buckets are held back: a bucket's rate is inverse to the share of texts that have it, plus a floor.

Training takes at most `TRAIN_ROWS` labelled documents (a documented bound): the labels with the smallest digests, and of
the documents that carry them, should ids repeat, those with the smallest digests of id and text. Their bags are made in
parallel; one task trains on them. Everything else covers all rows, and whole texts are scored.

Defined results: a null, empty or blank text has no words and scores 0. Repeated rows get equal scores. Labels that are
null or belong to no document are not used; an id with both labels counts once for each. Without any usable label every
score is 0. A null key is never labelled and not held out. Empty tables give empty results. Columns that are asked for stay
as they are and are replaced by added ones of the same name.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import materialize

TRAIN_ROWS = 6_000
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
WIDTH, ROUNDS, BATCH, RATE, FLOOR, BIAS = 16, 8, 128, 30.0, 0.01, -5.0
#: most toxic distinct words that count in a score
TOP = 16
#: distinct words that a task remembers at once
REMEMBERED = 1 << 19


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all subwords of all words."""
    codes = np.frombuffer("".join(f"<{w}>\n" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    of = np.repeat(np.arange(len(words)), ends + 1 - starts)
    place = (np.arange(len(codes)) - starts[of]).astype(np.uint64)
    whole = np.add.reduceat(_mixed(codes + (place << np.uint64(32))), starts)  # of code points and their places
    numbers, hashes = [np.arange(len(words))], [_mixed(whole)]
    for n in SIZES:
        if len(codes) <= n:
            break
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j:len(codes) - n + 1 + j]
        on = ends[of[:len(h)]] - np.arange(len(h)) >= n  # the gram ends before the word's end
        numbers.append(of[:len(h)][on])
        hashes.append(_mixed(h[on]))
    return np.concatenate(numbers), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()  # of bytes: splits at 0x20 and 0x09-0x0D only


def bags_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the bags of a text's distinct words, and their buckets, word by word."""
    ws = list(dict.fromkeys(words_of(text)))
    if not ws:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    number, bucket = subwords([w.decode() for w in ws])
    return np.bincount(number).astype(np.int32), bucket[np.argsort(number, kind="stable")].astype(np.int32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Embeddings, softmax weights and bias (of class 1 against class 0) for texts given as bags."""
    rng = np.random.default_rng(seed)
    table, top, bias = rng.uniform(-0.1, 0.1, (BUCKETS, WIDTH)).astype(np.float32), rng.normal(0, WIDTH**-0.5, (WIDTH, 2)).astype(np.float32), BIAS
    seen = np.zeros(BUCKETS)
    for _, buckets in rows:
        seen[np.unique(buckets)] += 1
    rate = (RATE / (seen / len(rows) + FLOOR)).astype(np.float32)[:, None]
    steps, step = ROUNDS * max(1, len(rows) // BATCH), 0
    speed, top_speed = np.zeros_like(table), np.zeros_like(top)
    for _ in range(ROUNDS):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            sizes, bucket = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
            word, text = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
            weights = top[:, 1] - top[:, 0]
            logit = np.bincount(word, (table @ weights)[bucket], len(sizes)) / sizes + bias
            # log of the probability that no word is toxic, and the loss's gradient by it
            clean = np.exp(-np.bincount(text, np.logaddexp(0, logit), len(pick)))
            by_clean = np.where(labels[pick] == 0, -1.0, np.minimum(clean / np.maximum(1 - clean, 1e-6), 50)) / len(pick)
            by_logit = -by_clean[text] / (1 + np.exp(-np.clip(logit, -50, 50)))
            sums = np.bincount(bucket, (by_logit / sizes)[word], BUCKETS).astype(np.float32)
            speed = 0.9 * speed + sums[:, None] * weights * rate
            top_speed = 0.9 * top_speed + (table.T @ sums)[:, None] * np.array([-1, 1], np.float32)
            left = 1 - step / steps
            table, top, bias, step = table - left * speed, top - 0.01 * left * top_speed, bias - 0.1 * by_logit.sum(), step + 1
    return table, top, float(bias)


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, train_rows: int) -> DataFrame:
    """(digest, label, sizes, buckets) of the sample: the bags of each document's distinct words."""
    known = labels.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").distinct().orderBy(F.xxhash64("id"), "id", "label").limit(train_rows)
    rows = docs.select(F.col(f"`{key}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    # at most train_rows labels: small enough for every task
    rows = rows.join(F.broadcast(known), "id").select(F.xxhash64("id", "text", "label").alias("digest"), "label", "text")
    rows = materialize(rows, "toxicity-labelled")
    cut = rows.select("digest").distinct().orderBy("digest").limit(train_rows).agg(F.max("digest")).first()[0]
    rows = rows.filter(F.col("digest") <= F.lit(cut)).dropDuplicates(["digest"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bags_of(t) for t in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), *[pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays(cols, names=["digest", "label", "sizes", "buckets"])

    return materialize(rows.mapInArrow(bags, "digest long, label int, sizes array<int>, buckets array<int>"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float] | None:
    """The trained model as far as a word's logit needs it: a number for each bucket, and the bias; None without labels."""
    sample = training_rows(docs, labels, text, key, label, train_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, known, rows = [], [], []
        for batch in batches:
            digests.append(batch.column(0).to_numpy())
            known.append(batch.column(1).to_numpy())
            rows += [tuple(batch.column(k)[i].values.to_numpy() for k in (2, 3)) for i in range(len(batch))]
        if not rows:
            return
        order = np.argsort(np.concatenate(digests))  # the model must not depend on the order of arrival
        table, top, bias = train([rows[i] for i in order], np.concatenate(known)[order])
        shares = (table @ (top[:, 1] - top[:, 0])).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([shares.tobytes()], pa.binary()), pa.array([bias])], names=["shares", "bias"])

    found = materialize(sample.coalesce(1).mapInArrow(learn, "shares binary, bias double"), "toxicity-model").collect()  # one row of a megabyte
    return (np.frombuffer(bytes(found[0]["shares"])), found[0]["bias"]) if found else None


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with score, the probability of label 1, and predicted."""
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted")]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    shares, bias = model
    rows = docs.select(F.struct(F.lit(0).alias("_0"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep, 1)]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share: dict[bytes, float] = {}
        for batch in batches:
            p = np.zeros(len(batch))
            for i, t in enumerate(batch.column(1)):
                ws = set(words_of(t.as_py()))
                new = [w for w in ws if w not in share]
                if new:
                    if len(share) + len(new) > REMEMBERED:
                        share.clear()
                        new = list(ws)
                    number, bucket = subwords([w.decode() for w in new])
                    share.update(zip(new, (np.bincount(number, shares[bucket]) / np.bincount(number) + bias).tolist(), strict=True))
                worst = heapq.nlargest(TOP, map(share.__getitem__, ws))
                p[i] = -np.expm1(-np.logaddexp(0, worst).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["row", "score", "predicted"])

    out = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double, predicted int")
    return out.select(*[F.col(f"row._{i}").alias(c) for i, c in enumerate(keep, 1)], "score", "predicted")


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def op13(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
