"""Byte-level BPE encoding and decoding as a tree reduction.

A text is cut in halves until a piece is short; the pieces are encoded alone and neighbours are joined up the
tree. A cut may fall inside a match of the split pattern, so a join encodes a window around the cut again. The
window grows until both of its ends lie on a *sync point*: a space or line feed after a character that is no
white space. No match of the pattern crosses a sync point, and whether a match ends there does not depend on what
follows, so the tokens left and right of the window are those of the whole text. Decoding joins the bytes of the
halves of the id list up the same kind of tree.

The tree runs inside the task that holds the row; rows are spread by Spark and never gathered.

Defined results: a null text is the empty text (no ids); repeated rows are encoded row by row; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: characters of a leaf when encoding, ids of a leaf when decoding
LEAF = 256
SYNC = re.compile(r"(?<=\S)[ \n]")


class TreeBpe:
    """Encoder and decoder for one rank table (bytes -> rank) and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self.leaf = leaf
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.n_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for b, i in ranks.items():
            self.n_bytes[i] = len(b)

    def _leaf(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_ordinary(text), dtype=np.uint32)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return self._leaf(text)
        mid = len(text) // 2
        left, right = text[:mid], text[mid:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, a: np.ndarray, right: str, b: np.ndarray) -> np.ndarray:
        """Ids of left + right, given the ids of both."""
        size = 32
        while True:
            lo, hi = max(0, len(left) - size), min(len(right), size)
            # the last sync point of the left half and the first of the right half inside the window; one
            # character more than the window is looked at, so that the character before a point is seen
            starts = [m.start() for m in SYNC.finditer(left, max(0, lo - 1))] if lo else [0]
            stops = SYNC.search(right, 0, hi) if hi < len(right) else None
            cut_a = starts[-1] if starts else None
            cut_b = stops.start() if stops else (len(right) if hi == len(right) else None)
            if cut_a is not None and cut_b is not None:
                break
            size *= 2
        middle = self._leaf(left[cut_a:] + right[:cut_b])
        return np.concatenate([a[: len(a) - self._tokens(a[::-1], left[cut_a:])], middle, b[self._tokens(b, right[:cut_b]):]])

    def _tokens(self, ids: np.ndarray, part: str) -> int:
        """How many of the first `ids` make up the bytes of `part`."""
        n, k = len(part.encode()), 64
        if n == 0:
            return 0
        while True:
            ends = np.cumsum(self.n_bytes[ids[:k]])
            if len(ends) and ends[-1] >= n:
                at = int(np.searchsorted(ends, n))
                if ends[at] != n:
                    raise AssertionError("a sync point lies inside a token")
                return at + 1
            if k >= len(ids):
                raise AssertionError("the ids are shorter than their text")
            k *= 4

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a `.tiktoken` file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CODERS: dict[tuple, TreeBpe] = {}


def coder(ranks_path: str, pattern: str, leaf: int = LEAF) -> TreeBpe:
    """The coder of a rank file, built once per Python worker."""
    key = (ranks_path, pattern, leaf)
    if key not in _CODERS:
        _CODERS[key] = TreeBpe(load_ranks(ranks_path), pattern, leaf)
    return _CODERS[key]


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", key: str = "doc_id",
                  with_ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """Per row: the key, n_tokens, ids_sha256 and decoded_sha256; with `with_ids` also the ids themselves.

    `ranks_path` must be readable on every executor (a file installed with the Python environment).
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(ranks_path, pattern, leaf)
        for frame in frames:
            rows: list[tuple] = []
            for k, t in zip(frame["key"], frame["text"], strict=True):
                ids = c.encode(t if isinstance(t, str) else "")
                row = (k, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest())
                rows.append((*row, ids.astype(np.int64).tolist()) if with_ids else row)
            yield pd.DataFrame(rows, columns=names)

    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>" * with_ids
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
