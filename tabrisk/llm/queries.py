"""Registered queries of this subpackage and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabrisk.llm import (
    bpe_tree,
    lattice,
    line_dedup,
    mixing,
    periodic_runs,
    phrases,
    quality_model,
    quality_rules,
    simhash,
    suffix_index,
    token_counts,
    toxicity,
    warc,
)
from tabrisk.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": lambda spark, d: mixing.op1(read_table(spark, d, "documents")),
    "op2_quality_model": lambda spark, d: quality_model.op2(read_table(spark, d, "documents")),
    "op3_warc": lambda spark, d: warc.op3(spark, read_table(spark, d, "pages")),
    "op4_token_counts": lambda spark, d: token_counts.op4(spark, read_table(spark, d, "documents")),
    "op5_quality_rules": lambda spark, d: quality_rules.op5(read_table(spark, d, "documents")),
    "quality_ablations": lambda spark, d: quality_rules.op5_ablations(read_table(spark, d, "documents")),
    "op6_lattice": lambda spark, d: lattice.op6(read_table(spark, d, "embeddings")),
    "op7_simhash": lambda spark, d: simhash.op7(read_table(spark, d, "documents")),
    "op8_line_dedup": lambda spark, d: line_dedup.op8(read_table(spark, d, "documents")),
    "op9_suffix_index": lambda spark, d: suffix_index.op9(read_table(spark, d, "documents")),
    "op10_bpe_tree": lambda spark, d: bpe_tree.op10(spark, read_table(spark, d, "documents")),
    "op11_periodic_runs": lambda spark, d: periodic_runs.op11(read_table(spark, d, "documents")),
    "op12_phrases": lambda spark, d: phrases.op12(read_table(spark, d, "documents")),
    "op13_toxicity": lambda spark, d: toxicity.op13(read_table(spark, d, "documents"), read_table(spark, d, "labels")),
}

ORACLE: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op3_warc": warc.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "quality_ablations": quality_rules.ABLATIONS_ORACLE,
    "op12_phrases": phrases.ORACLE,
}
