"""The n oldest ids by distributed selection."""

import random

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tabrisk.operators import query as Q
from tabrisk.sources.tables import read_table


def smallest(ids, n):
    return sorted(i for i in ids if i is not None)[:n]


@pytest.mark.parametrize("ids", [
    list(range(500)), [7] * 300 + list(range(5)) + [9] * 20, [None, 3, None, 1], [],
    [-(1 << 63), (1 << 63) - 1, 0, -1, 1, 5, 5, 5], [random.Random(4).randrange(-10**15, 10**15) for _ in range(400)],
])
def test_smallest_ids(spark, ids):
    df = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, x int").repartition(3)
    for n in (1, 2, 5, 7, 100, 305, 399, 1000):
        got = Q.oldest_n(df, "id", n).collect()
        assert sorted(r["id"] for r in got) == smallest(ids, n) and len({r["x"] for r in got}) == len(got)


def test_other_id_types(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i, i % 100) for i in range(200)], "s string, i int, b int")
    assert sorted(r["s"] for r in Q.oldest_n(df, "s", 3).collect()) == ["k000", "k001", "k002"]
    assert sorted(r["i"] for r in Q.oldest_n(df.withColumn("b", F.col("b").cast("byte")), "b", 3).collect()) in ([0, 1, 100], [0, 1, 101], [0, 100, 1], [0, 100, 101])
    with pytest.raises(ValueError):
        Q.oldest_n(df, "i", 0)


def test_plan_reads_by_bound(spark):
    events = read_table(spark, SF001, "events")
    plan = Q.oldest_n(Q.watermark_filter(events, "event_id", 99), "event_id", 50)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(event_id,149)" in plan and "GreaterThan(event_id,99)" in plan
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan
