"""Stored intermediate tables with measured sizes.

A DataFrame made from an RDD or a checkpoint has no size that the planner knows, so the other side of its joins
is shuffled even if it holds a few rows. Written as Parquet below the shared checkpoint folder and read back, its
files tell the planner how large it is: it is broadcast below the session's threshold and shuffled above it, without
a hint and without counting rows. The lineage is cut at a table that every executor can read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabrisk.session import scratch_path


def stored(df: DataFrame, kind: str = "stored") -> DataFrame:
    path = scratch_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
