"""Models, scoring, persistence and incremental learning (invariants; no SQL oracle exists for these)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tabrisk.operators import models as MD
from tabrisk.operators.metrics import auc
from tabrisk.plans import catalog
from tabrisk.streaming import online as O


@pytest.fixture(scope="module")
def prepared(spark):
    df = catalog.lineitem_labeled(spark, SF001)
    folds = MD.stratified_folds(df, "row_key", "label", 4, 42).cache()
    train, test = folds.filter("fold <> 0"), folds.filter("fold = 0")
    prep = MD.fit_feature_prep(train, catalog.LINE_CAT, catalog.LINE_NUM, keep=["row_key", "label"])
    return prep, train, test


def test_forest_learns_planted_label(spark, prepared):
    prep, train, test = prepared
    m = MD.forest(num_trees=20, max_depth=8).fit(prep.transform(train))
    s = MD.score_batch(prep, m, test, keep=["label"])
    assert s.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    assert auc(s).first().auc > 0.95


def test_boost_keeps_no_node_table_and_grows_the_same_trees(spark, prepared):
    """Storing every row's node at each level took more than half the time of a round."""
    prep, train, _ = prepared
    x = prep.transform(train)
    assert MD.forest().getCacheNodeIds() and not MD.boost().getCacheNodeIds()
    plain, cached = (MD.boost(rounds=3).setCacheNodeIds(keep).fit(x) for keep in (False, True))
    assert plain.toDebugString.split("\n")[1:] == cached.toDebugString.split("\n")[1:]


def test_stack_and_persistence(spark, prepared, tmp_path):
    prep, train, test = prepared
    stack = MD.StackingClassifier([MD.forest(num_trees=5, max_depth=5), MD.boost(rounds=5, max_depth=3, rate=0.3)],
                                  "row_key", inner_folds=2).fit(prep.transform(train))
    s1 = MD.score_batch(prep, stack, test, keep=["row_key"]).orderBy("row_key").collect()
    from tabrisk.sources.state import load_scorer, save_scorer
    save_scorer(str(tmp_path / "m"), prep, stack, spark)
    prep2, stack2 = load_scorer(str(tmp_path / "m"))
    s2 = MD.score_batch(prep2, stack2, test, keep=["row_key"]).orderBy("row_key").collect()
    assert [r.score for r in s1] == pytest.approx([r.score for r in s2])


def _events(spark):
    return catalog.events_labeled(spark, SF001)


def test_incremental_batches(spark, tmp_path):
    store = O.OnlineStore(spark, str(tmp_path / "online"))
    cfg = catalog._online_cfg()
    t = _events(spark)
    r1 = O.incremental_batch(spark, t, cfg, store, n=10).first()
    assert r1.status == "trained" and r1.samples_trained == 10 and r1.last_trained_id == 9
    r2 = O.incremental_batch(spark, t, cfg, store, n=50).first()
    assert r2.id_range == "10-59" and r2.batch_id == 1
    left = t.count() - 60
    r3 = O.incremental_batch(spark, t, cfg, store).first()
    assert r3.samples_trained == left
    r4 = O.incremental_batch(spark, t, cfg, store, n=5).first()
    assert r4.status == "no_data"
    hist = O.history_view(store.log()).orderBy("batch_id").collect()
    ranges = [tuple(map(int, h.id_range.split("-"))) for h in hist[1:]]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))  # id ranges never overlap
    with pytest.raises(ValueError):
        O.incremental_batch(spark, t, cfg, store, n=0)


def test_one_class_batch_has_null_auc(spark, tmp_path):
    store = O.OnlineStore(spark, str(tmp_path / "online1"))
    t = _events(spark).withColumn("is_error", F.lit(0))
    r = O.incremental_batch(spark, t, catalog._online_cfg(), store, n=20).first()
    assert r.status == "trained" and r.metrics.auc_score is None


def test_stream_replay_is_idempotent(spark, tmp_path):
    from tabrisk.sources.tables import table_path
    src = table_path(SF001, "events")
    glob = src[:-1] + "[t]"
    schema = spark.read.parquet(src).schema
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    derive = lambda b: b.select("event_id", "value", F.hour("ts").cast("double").alias("hour"),
                                (F.col("event_type") == "error").cast("int").alias("is_error"))
    ck = str(tmp_path / "ck")
    O.run_stream(spark, glob, schema, catalog._online_cfg(), store, ck, derive=derive)
    n1 = store.log().count()
    # same checkpoint: nothing new to read, nothing recorded twice
    O.run_stream(spark, glob, schema, catalog._online_cfg(), store, ck, derive=derive)
    assert store.log().count() == n1 == 1


def test_gradient_steps_match_numpy(spark):
    import numpy as np
    rows = [(float(i % 7), float(i % 3), int(i % 4 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    w, b = O.gradient_steps(df, ["a", "b"], "y", [0.0, 0.0], 0.0, 0.1, 3)
    X = np.array([[r[0], r[1]] for r in rows]); y = np.array([r[2] for r in rows])  # noqa: E702
    ww, bb = np.zeros(2), 0.0
    for _ in range(3):
        p = 1 / (1 + np.exp(-(X @ ww + bb)))
        ww, bb = ww - 0.1 * ((p - y) @ X) / len(y), bb - 0.1 * (p - y).mean()
    assert w == pytest.approx(list(ww)) and b == pytest.approx(bb)


def test_partition_sgd_single_partition_is_sequential_sgd(spark):
    rows = [(float(i % 5), int(i % 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "a double, y int").coalesce(1)
    w, b = O.partition_sgd(df, ["a"], "y", [0.0], 0.0, 0.01, 1e-4)
    ww, bb = 0.0, 0.0
    for a, y in rows:
        p = 1 / (1 + math.exp(-(a * ww + bb)))
        g = p - y
        ww, bb = ww - 0.01 * (g * a + 1e-4 * ww), bb - 0.01 * g
    assert w[0] == pytest.approx(ww) and b == pytest.approx(bb)


def test_stream_trains_each_micro_batch_once(spark, tmp_path):
    """Three files arrive in order; each micro-batch (one file) is one trained batch with its own id range."""
    src = str(tmp_path / "landing")
    ev = catalog.events_labeled(spark, SF001).select("event_id", "value", "hour", "is_error")
    n = ev.count()
    for i in range(3):  # separate jobs so the files are discovered in id order
        ev.filter((F.col("event_id") >= i * n // 3) & (F.col("event_id") < (i + 1) * n // 3)) \
            .coalesce(1).write.mode("append").parquet(src)
    store = O.OnlineStore(spark, str(tmp_path / "st3"))
    hist = O.run_stream(spark, src, ev.schema, catalog._online_cfg(), store, str(tmp_path / "ck3"))
    rows = hist.orderBy("batch_id").collect()
    assert [r.batch_id for r in rows] == [0, 1, 2]
    assert sum(r.samples_trained for r in rows) == n
    his = [int(r.id_range.split("-")[1]) for r in rows]
    assert his == sorted(his)


def test_stream_trains_every_row_of_files_with_mixed_ids(spark, tmp_path):
    """Four files that each hold ids from the whole range: no row is dropped, a replay adds none."""
    src = str(tmp_path / "mixed")
    ev = catalog.events_labeled(spark, SF001)
    for i in (3, 0, 2, 1):
        ev.filter(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(src)
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    O.run_stream(spark, src, ev.schema, catalog._online_cfg(), store, str(tmp_path / "ck"))
    rows = store.log().orderBy("batch_id").collect()
    assert len(rows) == 4 and all(r.status == "trained" for r in rows)
    assert sum(r.samples_trained for r in rows) == ev.count()
    top = ev.agg(F.max("event_id")).first()[0]
    assert max(r.last_trained_id for r in rows) == rows[-1].last_trained_id == top
    O.run_stream(spark, src, ev.schema, catalog._online_cfg(), store, str(tmp_path / "ck"))
    assert store.log().count() == 4


def test_empty_micro_batch_leaves_a_row(spark, tmp_path):
    src = str(tmp_path / "empty")
    ev = catalog.events_labeled(spark, SF001)
    ev.limit(0).coalesce(1).write.parquet(src)
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    O.run_stream(spark, src, ev.schema, catalog._online_cfg(), store, str(tmp_path / "ck"))
    assert [r.status for r in store.log().collect()] == ["no_data"]


def test_unreadable_log_counts_as_empty(spark, tmp_path):
    (tmp_path / "st" / "log").mkdir(parents=True)
    (tmp_path / "st" / "log" / "part-0.parquet").write_bytes(b"no parquet file at all")
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    assert store.log().count() == 0 and store.latest() is None


def test_score_with_the_incremental_model(spark, tmp_path):
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    t = catalog.events_labeled(spark, SF001)
    with pytest.raises(ValueError):
        O.score_incremental(t, store)
    O.incremental_batch(spark, t, catalog._online_cfg(), store)
    s = O.score_incremental(t, store, keep=["is_error"])
    assert s.columns == ["is_error", "score", "pred"] and s.count() == t.count()
    assert s.filter("score < 0 OR score > 1 OR pred <> CAST(score > 0.5 AS INT)").count() == 0
