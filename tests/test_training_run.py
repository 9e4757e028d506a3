"""A training run that is lost and goes on, and fits that run side by side."""

import threading
import time

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tabrisk.operators import models as MD
from tabrisk.operators.metrics import fold_metrics
from tabrisk.operators.training import FINAL, FOLD, TrainingRun
from tabrisk.plans import catalog


@pytest.fixture(scope="module")
def table(spark):
    return catalog.lineitem_labeled(spark, SF001).limit(1500).dropDuplicates(["row_key"]).cache()


class Fits:
    """Fits small pairs, counts them, and loses the driver at a given one."""

    def __init__(self, lost_at=None):
        self.n, self.lost_at, self.lock = 0, lost_at, threading.Lock()

    def __call__(self, train):
        with self.lock:
            self.n += 1
            if self.n == self.lost_at:
                raise KeyboardInterrupt("driver lost")
        prep = MD.fit_feature_prep(train, catalog.LINE_CAT, catalog.LINE_NUM, keep=["fold", "_y", "label"])
        return prep, MD.boost(rounds=2, max_depth=3, rate=0.3).fit(prep.transform(train))


def test_a_lost_run_goes_on_with_what_is_left(spark, table, tmp_path):
    first, again = Fits(lost_at=3), Fits()
    run = TrainingRun(spark, str(tmp_path / "run"), "row_key", threads=1)
    with pytest.raises(KeyboardInterrupt):
        run.run(table, first)
    assert {n for n in run.done() if n >= FOLD} == {FOLD, FOLD + 1} and FINAL not in run.done()
    found = TrainingRun(spark, str(tmp_path / "run"), "row_key", threads=1).run(table.limit(0), again)  # the stored folds are used
    assert again.n == 4  # three folds and the final fit
    whole = TrainingRun(spark, str(tmp_path / "whole"), "row_key", threads=3).run(table, Fits())
    key = lambda df: {r["fold"]: (r["accuracy"], r["log_loss"], r["auc"]) for r in df.collect()}
    got, want = key(found.per_fold), key(whole.per_fold)
    assert got.keys() == want.keys() == set(range(5)) and all(got[f] == pytest.approx(want[f], abs=0.05) for f in got)  # rows are stored in another order
    last = Fits()
    TrainingRun(spark, str(tmp_path / "run"), "row_key").run(table, last)
    assert last.n == 0 and found.registry.versions.numbers() == [0]


def test_results_and_settings(spark, table, tmp_path):
    run = TrainingRun(spark, str(tmp_path / "run"), "row_key", k=3)
    found = run.run(table, Fits())
    assert run.fold_scores().count() == table.count() and found.auc > 0.9
    assert {r["metric"] for r in found.summary.collect()} == {"accuracy", "log_loss", "auc"}
    assert [r["class"] for r in found.report.collect()] == ["0", "1", "accuracy", "macro avg", "weighted avg"] and found.roc.count() > 2
    means = fold_metrics(run.fold_scores()).agg(F.avg("auc")).first()[0]
    assert means == pytest.approx({r["metric"]: r["mean"] for r in found.summary.collect()}["auc"])
    with pytest.raises(ValueError):
        TrainingRun(spark, str(tmp_path / "run"), "row_key", k=4).run(table, Fits())


def test_run_all_is_concurrent_ordered_and_stops(spark):
    order, ran = [], []

    def task(i):
        order.append(("start", i))
        time.sleep(0.3)
        order.append(("end", i))
        return spark.range(10 * i).count()

    assert MD.run_all(spark, [lambda i=i: task(i) for i in range(4)], 4) == [0, 10, 20, 30]
    assert [x for x, _ in order[:4]] == ["start"] * 4
    with pytest.raises(ZeroDivisionError):
        MD.run_all(spark, [lambda: 1 / 0] + [lambda i=i: (time.sleep(0.2), ran.append(i)) for i in range(9)], 1)
    assert len(ran) < 9


def test_spread_goes_by_rows(spark):
    few = spark.range(1000).coalesce(1)
    assert MD.spread(few).rdd.getNumPartitions() == 1 and MD.spread(few, rows=300).rdd.getNumPartitions() == 4
    many = spark.range(1000).repartition(64)
    assert MD.spread(many).rdd.getNumPartitions() == 64


def test_parts_grow_with_the_rows(spark, monkeypatch):
    """Folds of a large table come in parts of bounded size, whatever the session's number of partitions."""
    from tabrisk.plans import ordering
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 50)
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert n < 40
    assert ordering.dealt(df, 2000, "k").groupBy("k").count().rdd.getNumPartitions() == 40 and ordering.dealt(df, 100, "k") is df
    tagged = MD.spread(MD.stratified_folds(df, "k", "label", 5, 42))
    assert tagged.rdd.getNumPartitions() >= 40 and tagged.count() == 2000
    assert MD.spread(df.coalesce(1)).rdd.getNumPartitions() == 40
