"""CSV export of a displayed list.

The list is written as it is displayed -- filtered and sorted -- with a header. Rows are not pulled to
the driver: a sorted DataFrame is range-partitioned, so part files hold consecutive slices in order.
An empty list writes nothing and reports ``empty`` (the original warns instead of writing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def export_csv(df: DataFrame, path: str) -> str:
    if df.isEmpty():
        return "empty"
    df.write.mode("errorifexists").option("header", True).csv(path)
    return "ok"


def read_export(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
