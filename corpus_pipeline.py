"""From raw documents to token digests: the corpus pipeline over the operators of tabrisk.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The stages defer to their operators for nulls, empty and
repeated rows; an empty table passes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabrisk.llm import bpe_tree, line_dedup, mixing, quality_rules, simhash
from tabrisk.llm.common import materialize, read_table


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go."""
    return quality_rules.keep_good(docs)


def drop_repeated_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has too are deleted; every document stays."""
    return line_dedup.without_repeated_blocks(docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of 3-word shingles are joined by 3 bits or less, one row of the smallest doc_id stays."""
    return simhash.keep_one_of_each(docs, size=3, distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in the shuffled order of its shards."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe_tree.op10(spark, docs)


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_blocks),
    ("simhash", keep_one_of_each),
    ("mixing", mix_sources),
    ("bpe", encode),
]

# SQL has neither XXH64 fingerprints nor byte-pair encoding; tests/llm/test_pipeline.py holds every stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
