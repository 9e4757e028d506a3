"""Concurrent writers of tables, versions of models, and a damaged training log."""

import threading

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from tabrisk.operators import models as MD
from tabrisk.plans import catalog
from tabrisk.sources.commits import CommitLog
from tabrisk.sources.snapshots import SnapshotStore, VersionConflict
from tabrisk.sources.state import ModelRegistry, load_scorer, save_scorer
from tabrisk.streaming import online as O


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "t"))
    store.commit(spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, x int"))
    return store


def changed(df, key, x):
    return df.withColumn("x", F.when(F.col("id") == key, F.lit(x)).otherwise(F.col("x")))


def ids(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "id int")


def test_one_number_goes_to_one_writer(spark, tmp_path):
    log, won = CommitLog(spark, str(tmp_path / "c")), []
    threads = [threading.Thread(target=lambda k=k: won.append((log.create(0, {"by": k, "text": "é\n"}), k))) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(ok for ok, _ in won) == 1
    assert log.get(0) == {"by": next(k for ok, k in won if ok), "text": "é\n"} and log.numbers() == [0]
    assert not list((tmp_path / "c").glob("_draft*"))


def test_lost_update_is_refused(spark, table):
    first, second = table.read(), table.read()
    assert table.commit(changed(first, 1, 99)) == 1
    with pytest.raises(VersionConflict):
        table.commit(changed(second, 2, 77))
    with pytest.raises(VersionConflict):
        table.commit(spark.createDataFrame([(9, 9)], "id int, x int"), base=0)
    assert rows(table.read()) == [(1, 99), (2, 20), (3, 30)] and rows(table.read(0))[0] == (1, 10)
    assert table.commit(changed(table.read(), 2, 77)) == 2


def test_disjoint_writers_both_succeed(spark, table):
    a, b, c = table.read(), table.read(), table.read()
    table.commit(changed(a, 1, 99), touched=ids(spark, 1))
    table.commit(b.filter("id <> 2"), touched=ids(spark, 2))  # a delete, carried over
    assert rows(table.read()) == [(1, 99), (3, 30)]
    with pytest.raises(VersionConflict):
        table.commit(changed(c, 1, 5), touched=ids(spark, 1, 3))
    assert rows(table.read()) == [(1, 99), (3, 30)] and table.version() == 2


def test_marks_survive_joins_and_name_the_oldest_version(spark, table):
    old = table.read()
    table.commit(changed(table.read(), 3, 31))
    mixed = old.join(table.read().select("id", F.col("x").alias("y")), "id")
    assert table.base_of(mixed) == 0 and table.base_of(table.read()) == 1 and table.base_of(spark.range(1)) is None
    assert table.base_of(SnapshotStore(spark, table.root + "x").spark.read.parquet(f"{table.root}/{table.versions.get(1)['parts'][0]}")) is None


def test_appends_share_parts_and_refuse_equal_new_ids(spark, table):
    assert table.append(ids(spark, 4).withColumn("x", F.lit(40)), base=0, touched=ids(spark, 4)) == 1
    assert table.append(ids(spark, 5), base=0, touched=ids(spark, 5)) == 2
    with pytest.raises(VersionConflict):
        table.append(ids(spark, 4), base=0, touched=ids(spark, 4))
    assert rows(table.read().filter("id > 3")) == [(4, 40), (5, None)] and len(table.versions.get(2)["parts"]) == 3
    update = changed(table.read(0), 1, 11)
    assert table.commit(update, touched=ids(spark, 1)) == 3 and table.read().count() == 5


def test_a_writer_that_dies_blocks_nobody(spark, table, monkeypatch):
    def die(*a):
        raise OSError("lost")
    monkeypatch.setattr(table.versions, "create", die)
    with pytest.raises(OSError):
        table.commit(changed(table.read(), 1, 0))
    monkeypatch.undo()
    assert table.version() == 0
    assert table.commit(changed(table.read(), 1, 5)) == 1 and table.append(ids(spark, 8)) == 2


@pytest.fixture(scope="module")
def fitted(spark):
    df = catalog.lineitem_labeled(spark, SF001).limit(800).cache()
    prep = MD.fit_feature_prep(df, catalog.LINE_CAT, catalog.LINE_NUM, keep=["row_key", "label"])
    x = prep.transform(df).cache()
    single = MD.boost(rounds=2, max_depth=2).fit(x)
    stack = MD.StackingClassifier([MD.forest(num_trees=2, max_depth=2), MD.boost(rounds=2, max_depth=2)], "row_key", inner_folds=2).fit(x)
    return df, prep, single, stack


def test_stack_saved_over_a_single_model(spark, fitted, tmp_path):
    df, prep, single, stack = fitted
    path = str(tmp_path / "m")
    for model in (single, stack, single):
        save_scorer(path, prep, model, check_df=df)
        got_prep, got = load_scorer(path)
        assert type(got) is type(model)
        want, found = (dict(rows(MD.score_batch(*pair, df, keep=["row_key"]))) for pair in ((prep, model), (got_prep, got)))
        assert found == pytest.approx(want)
    reg = ModelRegistry(spark, path)
    assert [type(reg.load(v)[1]) for v in (0, 1, 2)] == [type(single), type(stack), type(single)]
    with pytest.raises(FileNotFoundError):
        reg.load(7)


def test_reader_during_a_save_sees_the_old_pair(spark, fitted, tmp_path, monkeypatch):
    df, prep, single, stack = fitted
    reg = ModelRegistry(spark, str(tmp_path / "m"))
    reg.save(prep, single)
    seen = []
    real = reg.versions.create
    monkeypatch.setattr(reg.versions, "create", lambda n, c: seen.append(type(ModelRegistry(spark, reg.root).load()[1])) or real(n, c))
    reg.save(prep, stack, {"auc": 0.5})  # both parts are written when the reader looks
    assert seen == [type(single)] and type(reg.load()[1]) is type(stack) and reg.note() == {"auc": 0.5}


def test_damaged_log_keeps_the_good_rows(spark, tmp_path):
    t, cfg = catalog.events_labeled(spark, SF001), catalog._online_cfg()
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    O.incremental_batch(spark, t, cfg, store, n=10)
    O.incremental_batch(spark, t, cfg, store, n=10)
    (tmp_path / "st" / "log" / "part-x.snappy.parquet").write_bytes(b"no parquet file at all")
    whole = next((tmp_path / "st" / "log").glob("part-0*.parquet")).read_bytes()
    (tmp_path / "st" / "log" / "part-y.snappy.parquet").write_bytes(whole[:40] + b"\0" * (len(whole) - 48) + whole[-8:])
    assert store.latest()["last_trained_id"] == 19 and store.log().count() == 2
    r = O.incremental_batch(spark, t, cfg, store, n=10).first()
    assert (r["batch_id"], r["id_range"]) == (2, "20-29")
    assert sorted(p.name for p in (tmp_path / "st" / "log_damaged").iterdir() if p.suffix == ".parquet") == ["part-x.snappy.parquet", "part-y.snappy.parquet"]


def test_failing_storage_is_not_an_empty_log(spark, tmp_path, monkeypatch):
    from pyspark.errors import PySparkException
    t, cfg = catalog.events_labeled(spark, SF001), catalog._online_cfg()
    store = O.OnlineStore(spark, str(tmp_path / "st"))
    O.incremental_batch(spark, t, cfg, store, n=10)
    monkeypatch.setattr(store, "_set_damaged_aside", lambda: 0)
    real = type(t).count
    monkeypatch.setattr(type(t), "count", lambda self: (_ for _ in ()).throw(PySparkException("storage is away")))
    with pytest.raises(PySparkException):
        store.latest()
    monkeypatch.setattr(type(t), "count", real)
    monkeypatch.undo()
    assert store.latest()["last_trained_id"] == 9
