"""The rows of the mix in their output shards."""

from collections import Counter

from pyspark.sql import functions as F

from tabrisk.llm import mixing


def test_every_shard_is_one_range_of_the_output(spark):
    # sorted by source, one file's worth each
    rows = [(s * 1000 + i, f"w{i} " * (1 + i % 9), f"src{s}") for s in range(3) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartitionByRange(3, "source")
    drawn = mixing.mix(docs, depth=2).select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.shard", "d.position").collect()
    out = mixing.mixed(docs, depth=2).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    # the rows stand in the order of all draws
    assert [r["doc_id"] for r in out] == [r["doc_id"] for r in sorted(drawn, key=lambda r: (r["shard"], r["position"]))]
    parts = {}
    for r in out:
        parts.setdefault(r["part"], Counter())[r["source"]] += 1
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum((c for c in parts.values()), Counter())
    for c in parts.values():
        assert len(c) == 3
        for s, n in total.items():
            assert abs(c[s] / sum(c.values()) - n / len(out)) < 0.15


def test_rows_without_an_id_stand_apart(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many", "a") for i in range(300)], "doc_id long, text string, source string")
    parts = mixing.mixed(docs, depth=0).withColumn("part", F.spark_partition_id()).groupBy("part").count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
