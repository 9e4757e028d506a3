"""Distributed global ordering helpers: consecutive ranks and running totals.

An unpartitioned window (``row_number() over (order by k)``) runs in a single task, which does not
survive a 100 TB table. Both helpers here use the two-pass method instead:

1. range-partition the rows on the total order (the key columns plus a tie-breaker), sort each
   partition, and tag every row with its partition number and in-partition position or running sum;
2. materialise that once (``checkpoint`` into the shared checkpoint folder, so that both later reads
   see the same partition boundaries -- range bounds come from sampling and are not stable across
   recomputation);
3. total each partition (one tiny row per partition), turn the totals into offsets on the driver
   (the list is as long as the number of partitions, not the data) and add them back with a
   broadcast join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.session import ensure_checkpoint_dir

#: rows that a partition should have at most on average, so that a task's share doesn't grow with the table
ROWS_PER_PART = 1 << 18


def parts_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_PART))


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to more partitions than the session's number, if ``rows`` rows need them: a grouping by ``keys`` takes it as it is."""
    n = parts_for(rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else df


def _target_partitions(df: DataFrame, partitions: int | None) -> int:
    """The session's number, or more where ``df`` (persisted) has more rows than that many partitions should hold."""
    if partitions:
        return partitions
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), parts_for(df.count()))


def _offsets(df: DataFrame, pid: str, value: str, out: str, spark, as_float: bool = False) -> DataFrame:
    totals = df.groupBy(pid).agg(F.sum(value).alias("_t")).collect()  # one row per partition
    acc, rows = (0.0 if as_float else 0), []
    for r in sorted(totals, key=lambda r: r[0]):
        rows.append((r[0], acc))
        acc += r[1] or 0
    schema = T.StructType([T.StructField(pid, T.IntegerType()),
                           T.StructField(out, T.DoubleType() if as_float else T.LongType())])
    return spark.createDataFrame(rows, schema)


def ranked(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
           partitions: int | None = None) -> DataFrame:
    """Add a 1-based consecutive rank along ``order`` (which must be a total order)."""
    src = df.persist(StorageLevel.MEMORY_AND_DISK)  # read by the range sample and the sort
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = _target_partitions(src, partitions)
    base = (src.repartitionByRange(n, *order).sortWithinPartitions(*order)
            .withColumn("_pid", F.spark_partition_id())
            .withColumn("_mid", F.monotonically_increasing_id()))
    base = base.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    base = base.checkpoint(eager=True)
    src.unpersist()
    counts = base.withColumn("_one", F.lit(1).cast("long"))
    offs = _offsets(counts, "_pid", "_one", "_off", spark)
    out = base.join(F.broadcast(offs), "_pid").withColumn(rank_col, F.col("_off") + F.col("_local") + 1)
    return out.drop("_pid", "_mid", "_local", "_off")


def cumulative(df: DataFrame, order: Sequence[Column], sum_cols: Sequence[str], suffix: str = "_cum",
               partitions: int | None = None) -> DataFrame:
    """Add running sums (inclusive) of ``sum_cols`` along ``order`` (a total order).

    The in-partition running sum is vectorised over Arrow batches (``mapInArrow``): the window form would
    need a second shuffle of the whole table to group rows by partition.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    cols = list(sum_cols)
    src = df.persist(StorageLevel.MEMORY_AND_DISK)  # read by the range sample and the sort
    n = _target_partitions(src, partitions)
    sorted_df = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = T.StructType(list(sorted_df.schema.fields) + [T.StructField("_pid", T.IntegerType())]
                          + [T.StructField(c + suffix, T.DoubleType()) for c in cols])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        carry = [0.0] * len(cols)
        for batch in batches:
            arrays = [*batch.columns, pa.array([pid] * batch.num_rows, pa.int32())]
            for i, c in enumerate(cols):
                values = pc.fill_null(pc.cast(batch.column(c), pa.float64()), 0.0)
                running = pc.add(pc.cumulative_sum(values), carry[i])
                if batch.num_rows:
                    carry[i] = running[-1].as_py()
                arrays.append(running)
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    local = sorted_df.mapInArrow(run, schema).checkpoint(eager=True)
    src.unpersist()
    # partition totals of every column from one aggregation (one row per partition)
    totals = local.groupBy("_pid").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in cols]).collect()
    acc = {c: 0.0 for c in cols}
    rows = []
    for r in sorted(totals, key=lambda r: r["_pid"]):
        rows.append((r["_pid"], *[acc[c] for c in cols]))
        for c in cols:
            acc[c] += r[c] or 0.0
    offs = spark.createDataFrame(rows, T.StructType([T.StructField("_pid", T.IntegerType())] + [
        T.StructField("_off_" + c, T.DoubleType()) for c in cols]))
    result = local.join(F.broadcast(offs), "_pid")  # one row per partition
    for c in cols:
        result = result.withColumn(c + suffix, F.col(c + suffix) + F.col("_off_" + c)).drop("_off_" + c)
    return result.drop("_pid")
