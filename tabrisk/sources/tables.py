"""Scans and key lookups.

Input is always read lazily: filters and column selections applied later reach the Parquet scan
(``PushedFilters`` / ``ReadSchema``). NaN is turned into NULL once, when raw input (CSV) becomes a
Parquet snapshot. A Parquet scan is left untouched, as wrapping every column in a NaN test would hide it from
filter pushdown; the search itself takes a NaN for missing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.functions import normalize_nans
from tabrisk.spec import TableSpec


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, normalize: bool = False) -> DataFrame:
    """Whole-table Parquet scan (S1). ``normalize=True`` maps NaN to NULL for files not written by us."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return normalize_nans(df) if normalize else df


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"):
    """S1 with the original's error contract: (DataFrame, message); a read error gives an empty
    DataFrame of the schema and the error text instead of failing the caller."""
    try:
        df = spark.read.schema(schema).format(fmt).load(path)
        df.schema  # noqa: B018 - resolve now so a missing path fails here
        return df, "ok"
    except Exception as e:  # noqa: BLE001
        return spark.createDataFrame([], schema), f"read failed: {str(e).splitlines()[0][:200]}"


def scan_good_files(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """S1 error contract at run time: (rows, messages), both lazy.

    Unreadable files among good ones don't fail the scan: the rows are those of the good files and of the readable part
    of damaged ones. The messages, ``(file, message)``, name each file that has no readable footer, or that gave fewer rows than its
    footer counts; no message means that the whole table was read. A sound file without rows can't be told from an unreadable one by its
    rows and is named ``no readable rows`` too. The messages cost a second scan, if they are asked for.
    A missing path gives no rows and one message. Faults of the storage (no access, lost blocks) are raised, not taken for damage.
    """
    rows, message = scan_or_empty(spark, path, schema, fmt)
    if message != "ok":
        return rows, spark.createDataFrame([(path, message)], "file string, message string")
    good = spark.read.schema(schema).option("ignoreCorruptFiles", True).format(fmt).load(path)
    name = F.col("_metadata.file_path").alias("file")
    files = spark.read.format("binaryFile").load(path).select(name)  # names only, no contents
    stated = good.select(name).groupBy("file").agg(F.count(F.lit(1)).alias("stated"))  # from the footers
    read = good.select(name, F.xxhash64(*[F.col(f"`{f.name}`") for f in good.schema.fields]).alias("h")).groupBy("file") \
        .agg(F.when(F.bit_xor("h").isNotNull(), F.count("h")).alias("read"))  # the digest is asked for, so every column is read
    text = F.when(F.col("stated").isNull(), F.lit("no readable rows")).when(
        F.coalesce("read", F.lit(0)) < F.col("stated"), F.format_string("damaged: %d of %d rows read", F.coalesce("read", F.lit(0)), F.col("stated")))
    found = files.join(stated, "file", "left").join(read, "file", "left").withColumn("message", text)
    return good, found.filter("message IS NOT NULL").select("file", "message")


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV scan, UTF-8 with or without BOM (Spark strips the BOM).

    With a schema the read is typed and PERMISSIVE: a malformed value becomes NULL and the raw line
    lands in ``_corrupt_record``. Without a schema every column is text (the profiler decides types).
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    if schema is not None:
        full = T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType(), True)])
        reader = reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord",
                                                                         "_corrupt_record")
    return normalize_nans(reader.csv(path))


def key_lookup(df: DataFrame, keys: DataFrame, spec: TableSpec, key_col: str = "key") -> DataFrame:
    """Batch key lookup (S2): one output row per requested key with a ``found`` flag.

    The table is probed with the key set (left semi join, so a small key set is broadcast and the table is not
    shuffled); only the few hits are joined to the keys. Of records that repeat an id the smallest by its other
    columns counts, as the original stops at its first hit.
    """
    idc = spec.id_col
    k = keys.select(F.col(key_col).cast(df.schema[idc].dataType).alias(idc)).distinct()
    other = [c for c in df.columns if c != idc]
    hits = df.join(k, idc, "left_semi").groupBy(idc).agg(F.min(F.struct(*other)).alias("_rec"))
    return k.join(hits, idc, "left").select(idc, F.col("_rec").isNotNull().cast("int").alias("found"),
                                            *[F.col(f"_rec.`{c}`").alias(c) for c in other])


def first_match(df: DataFrame, spec: TableSpec, key) -> DataFrame:
    """One key, early stop: ``filter(id == k).limit(1)`` (pushed to Parquet, stops at the first row)."""
    return df.filter(F.col(spec.id_col) == F.lit(key)).limit(1)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its (Hadoop-compatible) file system, without a failing read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
