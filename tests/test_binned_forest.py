"""the forest is fitted over distinct binned rows, with the trees of the plain fit, and nothing is read or scored by a single task."""

import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabrisk.operators import bins as B
from tabrisk.operators import models as MD


@pytest.fixture(scope="module")
def rows(spark):
    """More rows than thresholds are taken from, more values than bins, zeros, copies, a constant and a rare value."""
    i = F.col("id")
    df = spark.range(15000, numPartitions=3).select(
        i, F.round(F.sin(i) * 100, 3).alias("a"), (i * 7919 % 50).cast("double").alias("b"), (i % 11 / 100).alias("c"),
        (i % 997 == 0).cast("double").alias("d"), F.lit(3.0).alias("e"))
    df = df.withColumn("label", ((F.col("a") + F.col("b") * 2 + F.col("c") * 100 > 60) != (F.col("id") % 53 == 0)).cast("int"))
    df = df.unionByName(df.filter("id < 3000"))
    return VectorAssembler(inputCols=list("abcde"), outputCol="features").transform(df).select("id", "label", "features").repartition(4).cache()


@pytest.fixture(autouse=True)
def merging(monkeypatch):
    """The forests here are small."""
    assert MD.forest().getNumTrees() * MD.forest().getMaxDepth() >= B.MERGE_FROM
    monkeypatch.setattr(B, "MERGE_FROM", 0)


def test_binned_forest_is_the_plain_forest(spark, rows):
    est = MD.forest(num_trees=6, max_depth=16)
    plain = est._copyValues(RandomForestClassifier()).fit(rows)
    p = MD.score_batch(_same(), plain, rows, keep=["id", "label"]).withColumnRenamed("score", "p").distinct()
    q = MD.score_batch(_same(), est.fit(rows), rows, keep=["id", "label"]).distinct()
    both = p.join(q, ["id", "label"])
    assert both.count() == 15000 and both.filter(F.abs(F.col("p") - F.col("score")) > 1e-12).count() == 0
    assert both.select("score").distinct().count() > 50


def test_fit_sees_each_binned_row_once(spark, rows, monkeypatch):
    seen = []
    merged = B.merged
    monkeypatch.setattr(B, "merged", lambda *a: seen.append(merged(*a)) or seen[-1])
    MD.forest(num_trees=2, max_depth=2).fit(rows)
    cells = seen[0]
    assert cells.agg(F.sum("_weight")).first()[0] == 18000
    assert cells.count() == cells.select("label", "_bins").distinct().count() < 15000


def test_leaves_hold_the_least_number_of_rows(spark):
    """Copies count: two equal rows are a leaf of two; of three rows no split leaves two on both sides."""
    def scores(values):
        df = spark.createDataFrame([(float(x), y) for x, y in values], "x double, label int").coalesce(1)
        x = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
        return sorted({round(r.score, 6) for r in MD.score_batch(_same(), MD.forest(num_trees=3).fit(x), x, keep=["x"]).collect()})
    assert scores([(1, 0), (1, 0), (2, 1), (2, 1)]) == [0.0, 1.0]
    assert scores([(1, 0), (2, 1), (2, 1)]) == [round(2 / 3, 6)]
    assert scores([(1, 0), (1, 0), (1, 1), (2, 1), (2, 1)]) == [round(1 / 3, 6), 1.0]


def test_binned_forest_is_stored_and_loaded(spark, rows, tmp_path):
    from tabrisk.sources.state import load_scorer, save_scorer
    model = MD.forest(num_trees=3, max_depth=4).fit(rows)
    prep = _same()
    save_scorer(str(tmp_path / "m"), prep, model, spark)
    prep2, model2 = load_scorer(str(tmp_path / "m"))
    a, b = (MD.score_batch(x, m, rows, keep=["id"]).agg(F.sum("score")).first()[0] for x, m in ((prep, model), (prep2, model2)))
    assert a == pytest.approx(b)


def test_spread_deals_empty_and_full_partitions_anew(spark):
    """A file of one row group gives many splits, all but one empty."""
    n = spark.sparkContext.defaultParallelism
    one = spark.range(200_000).repartition(2 * n, F.lit(1))
    sizes = [r[1] for r in MD.spread(one).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 200_000 and max(sizes) <= 100_000


def _same():
    from pyspark.ml import PipelineModel
    return PipelineModel([])
