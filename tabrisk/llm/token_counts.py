"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_bytes, n_tokens). A run joins the digests of its
distinct contents and of the tokenizer version to the stored counts, encodes only the distinct contents that are
missing, and appends their counts. The result is read from the cache, so a text that occurs in many documents is
encoded once.

The encoding of a content is itself split where no token can cross, at a space or line feed after a character
that is no white space; the pieces of a batch are encoded once each. That changes no count and spares most of
the encoder's work, as most pieces are words that come again.

Defined results: a null text is the empty text with 0 tokens and shares its cache row; repeated rows
each get their count; an empty table appends nothing.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.session import scratch_path

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_bytes bigint, n_tokens bigint"
# A text is cut before every space or line feed that follows a non-space character. `WORDS` finds the pieces fast
# where a text has no other kind of white space; `CUTS` gives the same pieces for any text.
WORDS = re.compile(r"\s*\S+|\s+\Z").findall
CUTS = re.compile(r"(?<=\S)(?=[ \n])").split
OTHER_SPACE = re.compile(r"[^\S \n]").search
MEMO = 500_000  # pieces that a Python worker remembers


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer version: of the vocabulary file and the library that reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|tokenizers " + tokenizers.__version__.encode()).hexdigest()


def split_pieces(text: str) -> list[str]:
    """The pieces of a text; joined they are the text again, and no token goes past a cut."""
    return CUTS(text) if OTHER_SPACE(text) else WORDS(text)


class PieceCounter:
    """Counts tokens of texts with the `tokenizers` library; remembers the counts of pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark spreads the work; a task is one thread
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [split_pieces(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = list({p for ps in pieces for p in ps if p not in memo})
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                memo[p] = len(e)
        return [sum(map(memo.__getitem__, ps)) for ps in pieces]


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The counter of a tokenizer file, built once per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The stored counts; an empty table where nothing has been stored yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm_path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def fill_cache(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text") -> str:
    """Append the counts of all contents of `docs` that the cache lacks; returns the tokenizer's digest."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(tokenizer_path)
        for frame in frames:
            for at in range(0, len(frame), 200):
                part = frame.iloc[at : at + 200]
                yield pd.DataFrame({"content_digest": part["content_digest"], "n_bytes": part["n_bytes"], "n_tokens": c.counts(part["text"].tolist())})

    content = F.coalesce(F.col(text), F.lit(""))
    contents = docs.select(F.sha2(content, 256).alias("content_digest"), F.octet_length(content).cast("long").alias("n_bytes"), content.alias("text"))
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer_digest") == version).select("content_digest")
    misses = contents.join(stored, "content_digest", "left_anti").dropDuplicates(["content_digest"])
    counted = misses.mapInPandas(run, "content_digest string, n_bytes bigint, n_tokens bigint")
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_bytes", "n_tokens").write.mode("append").parquet(cache_path)
    return version


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """`docs` without its text, with n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    version = fill_cache(docs, cache_path, tokenizer_path, text)
    cache = read_cache(docs.sparkSession, cache_path).filter(F.col("tokenizer_digest") == version)
    # two runs that fill the same cache at once may store a content twice, with equal counts
    cache = cache.groupBy("content_digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens"))
    rest = [c for c in docs.columns if c not in (text, "content_digest", "n_bytes", "n_tokens", "over_limit")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in rest], F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_digest"))
    return keyed.join(cache, "content_digest").select(*[F.col(f"`{c}`") for c in rest], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts with a cache of its own, so that a run encodes every distinct text."""
    import public_tokenizers

    return token_counts(docs.select("doc_id", "text"), scratch_path(spark, "token-cache"), public_tokenizers.path("byte_bpe_50k.json"))
