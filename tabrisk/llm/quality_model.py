"""Quality classifier from weak labels.

1. Heuristic labellers look at a document's measurements and vote good, bad or nothing. They overlap and none is exact.
2. Expectation-maximisation over all documents estimates how often each labeller votes what for good and for bad
   documents, and with it the probability that a document is good given all its votes. Documents count by their pattern of
   votes: the table of patterns has at most 3^8 rows, whatever the corpus holds, and is all the driver sees.
3. The posterior labels train a linear scorer over hashed features: words, and shapes of words. It is fitted on a sample of
   at most `TRAIN_ROWS` documents (a documented bound; those with the smallest digests of id and text, equal rows once),
   each in both classes with its posterior as weight. It scores every document whole.

Defined results: a null or blank text casts the vote of a short text and is scored by the intercept and so by its lack of
features. Repeated rows get equal scores. If all posteriors are on one side the scorer is still fitted, as both classes
carry weight. Where no document falls into the sample (a large table of few different rows) a document's score is the
posterior of its votes. Missing and repeated ids don't matter to the sample. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.llm.common import SPACES, let, materialize, words

TRAIN_ROWS = 20_000
FEATURES = 1 << 16
GOOD, NONE, BAD = 1, 0, 2
SYMBOLS = "#*$%&|<>"
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# fixed value: frequent function words of English, French, German and Spanish
STOP_WORDS = ["a", "and", "be", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
              "au", "de", "des", "du", "en", "est", "et", "la", "le", "les", "que", "un", "une",
              "das", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu",
              "como", "con", "del", "el", "los", "no", "para", "por", "se"]

# name -> (condition to vote bad, condition to vote good) over the measurements
LABELLERS: dict[str, tuple[str, str]] = {
    "length": ("n_words = 0", "n_words >= 50"),
    "symbols": ("10 * n_symbols > n_words", "n_words >= 10 AND 100 * n_symbols <= n_words"),
    "capitals": ("10 * n_upper > 3 * word_chars AND n_words >= 10", "10 * n_upper < word_chars AND n_words >= 10"),
    "lines": ("5 * n_dup_lines > 2 * n_lines AND n_lines >= 3", "n_dup_lines = 0 AND n_lines >= 2"),
    "echo": ("10 * n_echo > n_words AND n_words >= 10", "50 * n_echo < n_words AND n_words >= 20"),
    "variety": ("n_words >= 20 AND n_words <= 2000 AND 4 * n_distinct < n_words", "n_words >= 20 AND 5 * n_distinct > 2 * n_words"),
    "function_words": ("n_words >= 20 AND 50 * n_stop < n_words", "n_words >= 10 AND 10 * n_stop >= n_words"),
    "word_length": ("n_words >= 10 AND (word_chars < 3 * n_words OR 2 * word_chars > 15 * n_words)", "n_words >= 10 AND word_chars >= 4 * n_words AND 10 * word_chars <= 65 * n_words"),
}


def measured(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """Kept columns, the words of the text and what the labellers look at; every text is looked at once."""
    t = F.coalesce(F.col(text), F.lit(""))
    removed = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("long")
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    of_words = let(words(F.lower(t)), lambda w: F.struct(
        w.alias("w"), F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_echo")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(*keep, of_words.alias("__w"), of_lines.alias("__l"), removed(SYMBOLS).alias("n_symbols"), removed(UPPER).alias("n_upper"),
                      (F.length(t).cast("long") - removed(SPACES)).alias("word_chars"), t.alias("__t"))
    return out.select("*", "__w.n_words", "__w.n_distinct", "__w.n_stop", "__w.n_echo", "__l.n_lines", "__l.n_dup_lines").withColumnRenamed("__w", "__words")


def votes() -> Column:
    """All votes as one number, a base-3 digit for each labeller."""
    code = F.lit(0)
    for k, (bad, good) in enumerate(LABELLERS.values()):
        code = code + F.when(F.expr(bad), BAD * 3**k).when(F.expr(good), GOOD * 3**k).otherwise(0)
    return code.cast("int")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, vote probabilities (class, labeller, vote) and share of good documents.

    A labeller that does not vote says nothing about the document: its silence has probability 1 in both classes. Starts from the share of good votes, so that class 1 is the one that the labellers call good.
    """
    n = len(LABELLERS)
    vote = (patterns[:, None] // 3 ** np.arange(n)[None, :]) % 3
    good, bad = (vote == GOOD).sum(axis=1), (vote == BAD).sum(axis=1)
    post = (good + 1.0) / (good + 3.0 * bad + 2.0)
    before = np.inf
    for _ in range(rounds):
        weight = np.stack([1 - post, post]) * counts
        share = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        table = np.empty((2, n, 3))
        for v in (GOOD, BAD):
            table[:, :, v] = weight @ (vote == v) + 0.5
        table[:, :, NONE] = 0
        table /= table.sum(axis=2, keepdims=True)
        table[:, :, NONE] = 1
        log = np.log(share)[:, None] + sum(np.log(table[:, k, :][:, vote[:, k]]) for k in range(n))
        top = log.max(axis=0)
        total = top + np.log(np.exp(log - top).sum(axis=0))
        post, now = np.exp(log[1] - total), float((counts * total).sum())
        if abs(now - before) <= tolerance * max(1.0, abs(now)):
            break
        before = now
    return post, table, float(share[1])


def shapes(text: Column) -> Column:
    """The shapes of a text's words: letters by case, digits, other characters as they are; runs of letters are one."""
    plain = F.translate(text, UPPER + LOWER + DIGITS, "A" * 26 + "a" * 26 + "0" * 10)
    return words(F.regexp_replace(F.regexp_replace(plain, r"[a\x{80}-\x{10FFFF}]+", "a"), "A+", "A"))


def features(docs: DataFrame, lower_words: Column, text: Column) -> DataFrame:
    """Adds `features`: hashed counts of words and word shapes, scaled to length one."""
    # a shape can't be mistaken for a word, as it carries a mark
    terms = F.concat(lower_words, F.transform(shapes(text), lambda s: F.concat(F.lit("\x00"), s)))
    counted = HashingTF(numFeatures=FEATURES, inputCol="__terms", outputCol="__tf").transform(docs.withColumn("__terms", terms))
    return Normalizer(inputCol="__tf", outputCol="features").transform(counted)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> tuple[LogisticRegressionModel | None, dict[int, float]]:
    """The scorer and the posterior of each pattern of votes; no scorer for an empty table."""
    ids = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    coded = materialize(measured(docs, text, []).select(votes().alias("code")), "quality-votes")
    table = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()  # at most 3^8 rows
    if not table:
        return None, {}
    patterns, counts = np.array([r["code"] for r in table]), np.array([r["n"] for r in table], dtype=float)
    post, _, _ = estimate(patterns, counts)
    posterior = {int(c): float(p) for c, p in zip(patterns, post, strict=True)}
    # the bound on the sample: the share of all digests that holds about nine tenths of train_rows
    share = 0.9 * train_rows / counts.sum()
    limit = (1 << 63) - 1 if share >= 0.9 else -(1 << 63) + int(share * (1 << 64))
    sample = docs.select(F.col(text), ids.alias("__id")).filter(F.col("__id") <= F.lit(limit)).dropDuplicates(["__id"])
    rows = features(measured(sample, text, []), F.col("__words.w"), F.col("__t"))
    rows = rows.withColumn("p", _posterior(votes(), posterior)).select("features", "p")
    both = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    train = materialize(rows.select("features", both.alias("x")).select("features", "x.label", "x.weight"), "quality-train")
    if train.isEmpty():
        return None, posterior
    return LogisticRegression(weightCol="weight", maxIter=50, regParam=1e-4).fit(train), posterior


def _posterior(code: Column, posterior: dict[int, float]) -> Column:
    """The posterior of a pattern, looked up in an array of all 3^8 patterns."""
    table = [posterior.get(c, 0.5) for c in range(3 ** len(LABELLERS))]
    return F.get(F.from_json(F.lit("[" + ",".join(map(repr, table)) + "]"), "array<double>"), code)


def score(docs: DataFrame, model: LogisticRegressionModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with score (the scorer's probability of good) and kept. The labellers aren't asked again."""
    keep = [c for c in (keep or docs.columns) if c not in ("score", "kept")]
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), t.alias("__t"))
    found = features(rows, words(F.lower(F.col("__t"))), F.col("__t"))
    scored = model.setFeaturesCol("features").transform(found.select("__row", "features"))
    p = vector_to_array("probability")[1]
    return scored.select("__row.*", p.alias("score"), (p >= 0.5).alias("kept"))


def score_by_votes(docs: DataFrame, posterior: dict[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score and kept by the posterior of each document's votes alone."""
    p = _posterior(votes(), posterior)
    return measured(docs, text, [F.col(key)]).select(key, p.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def op2(docs: DataFrame) -> DataFrame:
    model, posterior = fit(docs)
    if model is None:
        return score_by_votes(docs.select("doc_id", "text"), posterior)
    return score(docs, model, keep=["doc_id"])
