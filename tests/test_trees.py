"""boosting from histograms gives the trees of Spark's fit, and its passes over the rows don't grow with the rounds."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabrisk.operators import models as MD
from tabrisk.operators import trees as T


@pytest.fixture(scope="module")
def rows(spark):
    """More rows than thresholds are taken from, more values than bins, zeros, copies, a constant, several partitions."""
    i = F.col("id")
    df = spark.range(15000, numPartitions=3).select(
        i, F.round(F.sin(i) * 100, 3).alias("a"), (i * 7919 % 50).cast("double").alias("b"), (i % 11 / 100).alias("c"), F.lit(3.0).alias("d"))
    df = df.withColumn("label", ((F.col("a") + F.col("b") * 2 + F.col("c") * 100 > 60) != (F.col("id") % 53 == 0)).cast("int"))
    df = df.unionByName(df.filter("id < 3000"))
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).select("id", "label", "features").repartition(4).cache()


def _scores(model, rows):
    return [r.score for r in rows.select("id", "features").transform(model.transform).select("id", MD.positive_probability("prob_gbt").alias("score")).orderBy("id", "score").collect()]


def _plain(est):
    return est._copyValues(GBTClassifier()).setProbabilityCol("prob_gbt").setRawPredictionCol("raw_gbt")


@pytest.mark.parametrize("merge_rows", [T.MERGE_ROWS, 0])
def test_boost_is_the_plain_boost(spark, rows, monkeypatch, merge_rows):
    """Samples, thresholds and splits are Spark's, whether rows are kept one by one or as cells."""
    monkeypatch.setattr(T, "MERGE_ROWS", merge_rows)
    est = MD.boost(rounds=6, rate=0.3)
    model = est.fit(rows)
    assert model.getNumTrees == 6 and model.treeWeights == pytest.approx([1.0] + [0.3] * 5)
    assert _scores(model, rows) == pytest.approx(_scores(_plain(est).fit(rows), rows), abs=1e-9)


def test_jobs_of_a_boosted_fit_do_not_grow_with_its_rounds(spark, rows):
    def jobs(rounds):
        group = f"boost-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        MD.boost(rounds=rounds).fit(rows)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    few, many = jobs(2), jobs(12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert few == many


def test_sample_of_a_block_does_not_need_those_before(monkeypatch):
    """A later block of a partition gets what one pass over all rows would give it."""
    whole = next(T.Sampler(0.8).masks(42, [(3, 0, T.BLOCK)]))
    assert 0.79 < whole.mean() < 0.81
    monkeypatch.setattr(T, "BLOCK", 1024)
    parts = list(T.Sampler(0.8).masks(42, [(3, k * 1024, 1024) for k in range(10)]))
    assert np.array_equal(np.concatenate(parts), whole[: 10 * 1024])


def test_labels_that_boosting_does_not_know_fail_as_before(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, None), (3.0, 1)], "x double, label int")
    x = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    with pytest.raises(Exception, match="(?i)label"):
        MD.boost(rounds=2).fit(x)


def test_cross_validation_refits_on_all_rows(spark):
    """k fits on the other folds, then one on every row."""
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("label"))
    seen = []

    def make(train):
        seen.append(train.count())
        return lambda part: part.withColumn("score", F.col("label") * 0.8 + 0.1)

    found = MD.cross_validate(df, make, "k", k=5)
    per, summary = found
    assert sorted(seen) == [80] * 5 + [100] and per.count() and summary.count()
    assert found.final(df.withColumn("fold", F.lit(0))).filter("score > 0.5").count() == 50


def test_forest_is_grown_from_cells_and_rows_take_the_score_of_theirs(spark, rows, monkeypatch):
    """no fit of Spark's over the rows, and the trees are walked once for each combination of bins."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier

    from tabrisk.operators import bins as B
    est = MD.forest(num_trees=6, max_depth=12)
    plain = est._copyValues(RandomForestClassifier()).fit(rows)
    want = plain.transform(rows).select("id", MD.positive_probability("prob_rf").alias("p")).distinct()
    monkeypatch.setattr(B, "MERGE_FROM", 0)
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda *a: pytest.fail("the plain fit ran"))
    model = est.fit(rows)
    walked = []
    walk = RandomForestClassificationModel._transform
    monkeypatch.setattr(RandomForestClassificationModel, "_transform", lambda self, df: walked.append(df.count()) or walk(self, df))
    got = MD.score_batch(PipelineModel([]), model, rows, keep=["id"])
    assert got.count() == 18000 and walked == [B.merged(model.stages[0].transform(rows), "label").select(B.BINS).distinct().count()] and walked[0] < 15000
    both = want.join(got.distinct(), "id")
    assert both.count() == 15000 and both.filter(F.abs(F.col("p") - F.col("score")) > 1e-12).count() == 0


def test_drawn_features_are_those_of_a_seed():
    """java.util.Random's numbers, found without those before them."""
    whole = T.java_longs(42, 0, 500)
    assert whole[:2].view(np.int64).tolist() == [-5025562857975149833, -5843495416241995736]
    assert np.array_equal(T.java_longs(42, 123, 300), whole[123:423])
    assert T.map_order([7, 2, 9]) == [9, 2, 7] and sorted(T.map_order(range(200))) == list(range(200))
