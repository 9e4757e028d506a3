"""Feature stages, KNN imputation, metrics and folds on hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabrisk.operators import features as FE
from tabrisk.operators import metrics as M
from tabrisk.operators.knn import KnnImputer
from tabrisk.operators.models import stratified_folds


def test_one_hot_unseen_and_names(spark):
    fit = spark.createDataFrame([("F",), ("M",)], "gender string")
    m = FE.OneHot(inputCols=["gender"]).fit(fit)
    out = m.transform(spark.createDataFrame([("F",), ("X",), (None,)], "gender string")).collect()
    assert m.outputCols() == ["gender_F", "gender_M"]
    assert [(r.gender_F, r.gender_M) for r in out] == [(1, 0), (0, 0), (0, 0)]


def test_one_hot_refuses_huge_domain(spark):
    df = spark.range(0, 50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        FE.OneHot(inputCols=["c"], maxCategories=10).fit(df)


def test_population_scaler(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    out = FE.PopulationScaler(inputCols=["a", "c"]).fit(df).transform(df).collect()
    assert [(r.a, r.c) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0, 9.0)], "id long, b double, extra double")
    r = FE.AlignFeatures(features=["a", "b"], keepCols=["id"]).transform(df)
    assert r.columns == ["id", "a", "b"] and tuple(r.first()) == (1, 0.0, 2.0)


def _brute_knn(rows, feats, k):
    n = len(feats)
    means = {c: (sum(r[c] for r in rows if r[c] is not None) / max(1, sum(r[c] is not None for r in rows)))
             for c in feats}
    out = {}
    for q in rows:
        res = dict(q)
        for c in feats:
            if q[c] is not None:
                continue
            cands = []
            for p in rows:
                if p[c] is None:
                    continue
                both = [f for f in feats if q[f] is not None and p[f] is not None]
                if not both:
                    continue
                d = (n / len(both) * sum((q[f] - p[f]) ** 2 for f in both)) ** 0.5
                cands.append((d, p["id"], p[c]))
            cands.sort()
            top = cands[:k]
            res[c] = sum(v for _, _, v in top) / len(top) if top else means[c]
        out[q["id"]] = res
    return out


def test_knn_matches_brute_force(spark):
    rnd = random.Random(7)
    feats = ["a", "b", "x", "y"]
    rows = []
    for i in range(300):
        rows.append({"id": i, "a": float(rnd.randint(0, 30)), "b": rnd.random() * 10,
                     "x": None if rnd.random() < 0.2 else rnd.random() * 5,
                     "y": None if rnd.random() < 0.15 else float(rnd.randint(0, 3))})
    rows.append({"id": 999, "a": 1.0, "b": 1.0, "x": None, "y": None})
    df = spark.createDataFrame([tuple(r[c] for c in ["id"] + feats) for r in rows],
                               "id long, a double, b double, x double, y double")
    model = KnnImputer(idCol="id", inputCols=feats, k=5).fit(df)
    got = {r.id: r for r in model.transform(df).collect()}
    want = _brute_knn(rows, feats, 5)
    for i, w in want.items():
        for c in feats:
            assert got[i][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9), (i, c)


def test_knn_few_and_no_donors(spark):
    rows = [(1, 0.0, None), (2, 1.0, 10.0), (3, 2.0, 20.0), (4, 50.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, v double")
    got = {r.id: r.v for r in KnnImputer(idCol="id", inputCols=["a", "v"], k=5).fit(df).transform(df).collect()}
    assert got[1] == pytest.approx(15.0) and got[4] == pytest.approx(15.0)
    allnull = spark.createDataFrame([(1, 0.0, None), (2, 1.0, None)], "id long, a double, v double")
    got = {r.id: r.v for r in KnnImputer(idCol="id", inputCols=["a", "v"], k=5).fit(allnull).transform(allnull).collect()}
    assert got == {1: None, 2: None}


def test_knn_all_columns_with_gaps_in_small_blocks(spark, monkeypatch):
    """No column is complete, rows miss many values, ids repeat; blocks and donor batches are tiny."""
    from tabrisk.operators import knn
    monkeypatch.setattr(knn, "QUERY_ROWS", 40)
    monkeypatch.setattr(knn, "DONOR_ROWS", 7)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 16)
    rnd = random.Random(3)
    feats = [f"c{i}" for i in range(20)]
    rows = [{"id": i, **{c: None if rnd.random() < 0.15 else round(rnd.random() * 9, 1) for c in feats}} for i in range(250)]
    rows.append({"id": 900, **{c: None for c in feats}})
    df = spark.createDataFrame([tuple(r[c] for c in ["id", *feats]) for r in rows], "id long, " + ", ".join(f"{c} double" for c in feats))
    got = {r.id: r for r in KnnImputer(idCol="id", inputCols=feats, k=5).fit(df).transform(df).collect()}
    for i, w in _brute_knn(rows, feats, 5).items():
        for c in feats:
            assert got[i][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9), (i, c)


def _knn_visits(spark, monkeypatch, rows, feats, k=5):
    """(imputed rows, (row, block) visits, incomplete rows, blocks) with small blocks."""
    from tabrisk.operators import knn
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(knn, "QUERY_ROWS", 32)
    seen, meet = [], knn.KnnImputerModel._meet
    monkeypatch.setattr(knn.KnnImputerModel, "_meet", lambda self, v: (seen.append(v), meet(self, v))[1])
    df = spark.createDataFrame([tuple(r[c] for c in ["id", *feats]) for r in rows], "id long, " + ", ".join(f"{c} double" for c in feats))
    model = knn.KnnImputer(idCol="id", inputCols=feats, k=k).fit(df)
    got = {r.id: r for r in model.transform(df).collect()}
    visits = sum(v.selectExpr("sum(size(bs)) AS n").first().n or 0 for v in seen)
    return got, visits, sum(any(r[c] is None for c in feats) for r in rows), model.boxes.count()


def test_knn_reads_few_blocks_of_clustered_donors(spark, monkeypatch):
    rnd = random.Random(12)
    feats = ["a", "b", "c", "d"]
    rows = []
    for i in range(1200):
        at = rnd.randrange(12) * 100.0
        rows.append({"id": i, **{c: None if c in "cd" and rnd.random() < 0.1 else at + rnd.random() for c in feats}})
    got, visits, incomplete, blocks = _knn_visits(spark, monkeypatch, rows, feats)
    for i, w in _brute_knn(rows, feats, 5).items():
        for c in feats:
            assert got[i][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9), (i, c)
    assert blocks == 60 and visits < 0.3 * incomplete * blocks


def test_knn_equal_donors_in_many_blocks(spark, monkeypatch):
    """A third of the rows are equal: their blocks are as near as the k-th donor, and the smallest ids win."""
    rnd = random.Random(13)
    feats = ["a", "b", "v"]
    rows = [{"id": 1000 - i, "a": 1.0, "b": 2.0, "v": float(rnd.randrange(50))} if i % 3 == 0 else
            {"id": 1000 - i, "a": float(rnd.randrange(4)), "b": float(rnd.randrange(4)), "v": None if rnd.random() < 0.3 else rnd.random()}
            for i in range(600)]
    got, visits, incomplete, blocks = _knn_visits(spark, monkeypatch, rows, feats, 3)
    for i, w in _brute_knn(rows, feats, 3).items():
        assert got[i]["v"] == pytest.approx(w["v"], rel=1e-9, abs=1e-9), i
    assert visits < incomplete * blocks


def test_knn_rows_travel_in_chunks(spark, monkeypatch):
    """Where every block is visited, a block travels once per chunk of rows, not once per row, and a span gives k donors for each gap."""
    from tabrisk.operators import knn
    monkeypatch.setattr(knn, "CHUNK_ROWS", (64, 64))
    monkeypatch.setattr(knn, "SPAN_ROWS", 160)
    rnd = random.Random(14)
    feats = [f"c{i}" for i in range(8)]
    rows = [{"id": i, **{c: None if rnd.random() < 0.08 else float(rnd.randrange(30)) for c in feats}} for i in range(500)]
    got, visits, incomplete, blocks = _knn_visits(spark, monkeypatch, rows, feats)
    for i, w in _brute_knn(rows, feats, 5).items():
        for c in feats:
            assert got[i][c] == pytest.approx(w[c], rel=1e-9, abs=1e-9), (i, c)
    assert incomplete > 200 and visits <= blocks * len(knn._chunks([(b, 1) for b in range(incomplete)], 32))
    assert knn._chunks([(5, 10), (0, 3), (2, 4), (7, 1)], 8) == [(0, 0, 1), (2, 0, 1), (5, 1, 2), (7, 3, 1)]


def test_knn_block_bound_is_never_above_a_distance():
    """Lower bounds hold to the last bit, with gaps, infinities and a block without a shared column."""
    import numpy as np

    from tabrisk.operators.knn import _Block, _Boxes
    rnd = np.random.default_rng(5)
    for _ in range(40):
        donors = rnd.normal(size=(30, 5)) * rnd.choice([1e-9, 1.0, 1e9], size=5)
        donors[rnd.random(donors.shape) < rnd.choice([0.0, 0.3, 0.9])] = np.nan
        if rnd.random() < 0.3:
            donors[0, 0] = np.inf
        x = np.concatenate([donors[:10], rnd.normal(size=(10, 5))])
        x[rnd.random(x.shape) < 0.3] = np.nan
        x[:, 4] = np.nan
        seen = ~np.isnan(donors)
        box = {"b": 0, "first": 1, "rows": 30, "has": seen.sum(axis=0).tolist(),
               "lo": [np.nanmin(c) if s.any() else None for c, s in zip(donors.T, seen.T)], "hi": [np.nanmax(c) if s.any() else None for c, s in zip(donors.T, seen.T)]}
        bound = _Boxes([box], 5).bounds(x)[:, 0]
        block = _Block(np.arange(20), x, 1)
        block.meet(donors, np.arange(30))
        assert (bound <= block.dist[4][:, 0]).all()


def test_knn_in_the_fitted_chain(spark, tmp_path):
    """KNN fill is a stage of the preparation: fitted, saved in a PipelineModel, loaded and applied to new rows."""
    from pyspark.ml import PipelineModel
    from tabrisk.operators.models import fit_feature_prep
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["x", "y", None]), *[None if rnd.random() < 0.2 else rnd.random() for _ in range(3)]) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, cat string, a double, b double, c double")
    prep = fit_feature_prep(df, ["cat"], ["a", "b", "c"], keep=["id"], missing="knn", id_col="id")
    prep.save(str(tmp_path / "prep"))
    again = PipelineModel.load(str(tmp_path / "prep"))
    a = {r.id: r.features.toArray().tolist() for r in prep.transform(df).collect()}
    b = {r.id: r.features.toArray().tolist() for r in again.transform(df).collect()}
    assert a == b and len(a) == 80
    mean = [sum(v[j] for v in a.values()) / 80 for j in range(3)]
    assert mean == pytest.approx([0, 0, 0], abs=1e-9)


def test_knn_tie_goes_to_lower_id(spark):
    rows = [(1, 0.0, None), (2, 1.0, 10.0), (3, -1.0, 20.0)]
    df = spark.createDataFrame(rows, "id long, a double, v double")
    got = {r.id: r.v for r in KnnImputer(idCol="id", inputCols=["a", "v"], k=1).fit(df).transform(df).collect()}
    assert got[1] == 10.0


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_auc_edges(spark):
    assert M.auc(_scored(spark, [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)])).first().auc == 0.5
    assert M.auc(_scored(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])).first().auc == 1.0
    assert M.auc(_scored(spark, [(1, 0.1), (0, 0.9)])).first().auc == 0.0
    assert M.auc(_scored(spark, [(1, 0.1), (1, 0.9)])).first().auc is None


def test_auc_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(3)
    pairs = [(int(rnd.random() < 0.4), round(rnd.random(), 2)) for _ in range(2000)]
    df = _scored(spark, pairs)
    ours = M.auc(df).first().auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    ref = ev.evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert ours == pytest.approx(ref, abs=1e-12)


def test_log_loss_clipped(spark):
    v = M.log_loss(_scored(spark, [(1, 0.0), (0, 1.0)])).first().log_loss
    assert math.isfinite(v) and v == pytest.approx(-math.log(1e-15), abs=2e-3)


def test_folds_keep_class_shares(spark):
    rows = [(i, 1 if i < 10 else 0) for i in range(103)]
    df = spark.createDataFrame(rows, "id long, y int")
    f = stratified_folds(df, "id", "y", 5, 42).groupBy("fold", "y").count().collect()
    pos = sorted(r["count"] for r in f if r.y == 1)
    neg = sorted(r["count"] for r in f if r.y == 0)
    assert pos == [2, 2, 2, 2, 2] and set(neg) <= {18, 19} and sum(neg) == 93


def test_class_report_and_confusion(spark):
    df = _scored(spark, [(1, 0.9), (1, 0.2), (0, 0.1), (0, 0.7), (0, 0.3)])
    cm = {r.actual: (r.pred_0, r.pred_1) for r in M.confusion_matrix(df).collect()}
    assert cm == {0: (2, 1), 1: (1, 1)}
    rep = {r["class"]: r for r in M.class_report(df).collect()}
    assert rep["accuracy"].precision == pytest.approx(0.6)
    assert rep["1"].precision == pytest.approx(0.5) and rep["0"].recall == pytest.approx(2 / 3)


def test_one_hot_case_only_values_get_distinct_columns(spark):
    fit = spark.createDataFrame([("Undefined Diagnoses",), ("Undefined diagnoses",)], "b string")
    m = FE.OneHot(inputCols=["b"]).fit(fit)
    assert m.outputCols() == ["b_Undefined Diagnoses", "b_Undefined diagnoses~2"]
    out = m.transform(fit).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 1)]


def test_knn_model_save_load(spark, tmp_path):
    rows = [(1, 0.0, None), (2, 1.0, 10.0), (3, 2.0, 20.0), (4, 3.0, 30.0)]
    df = spark.createDataFrame(rows, "id long, a double, v double")
    m = KnnImputer(idCol="id", inputCols=["a", "v"], k=2).fit(df)
    m.save(str(tmp_path / "knn"))
    from tabrisk.operators.knn import KnnImputerModel
    m2 = KnnImputerModel.load(str(tmp_path / "knn"))
    assert {r.id: r.v for r in m2.transform(df).collect()} == {r.id: r.v for r in m.transform(df).collect()}


def test_roc_thinning(spark):
    rnd = random.Random(11)
    df = _scored(spark, [(int(rnd.random() < 0.3), rnd.random()) for _ in range(3000)])
    full = M.roc_curve(df).collect()
    thin = M.roc_curve(df, bins=10).collect()
    assert len(thin) <= 11 < len(full)
    assert max(r.fpr for r in thin) == 1.0 and max(r.tpr for r in thin) == 1.0


def test_scan_good_files(spark, tmp_path):
    """Garbage and a damaged file among good ones: the good rows, and a message for each of the two."""
    from tabrisk.sources.tables import scan_good_files
    schema = "id long, v string"
    table = tmp_path / "table with blanks"
    table.mkdir()
    for i in range(3):
        part = spark.range(i * 1000, i * 1000 + 1000).selectExpr("id", "sha2(cast(id AS string), 256) AS v").coalesce(1)
        part.write.option("compression", "snappy").parquet(str(tmp_path / f"p{i}"))
        [file] = (tmp_path / f"p{i}").glob("*.parquet")
        data = bytearray(file.read_bytes())
        if i == 1:
            data[4 : len(data) // 2] = b"\xff" * (len(data) // 2 - 4)  # the footer stays as it is
        (table / f"{i}.parquet").write_bytes(bytes(data))
    (table / "3.parquet").write_bytes(b"not a table")
    rows, messages = scan_good_files(spark, str(table), schema)
    assert {r.id for r in rows.collect()} == {*range(1000), *range(2000, 3000)}
    got = {r.file.rsplit("/", 1)[1]: r.message for r in messages.collect()}
    assert got == {"1.parquet": "damaged: 0 of 1000 rows read", "3.parquet": "no readable rows"}
    (table / "1.parquet").unlink()
    (table / "3.parquet").unlink()
    rows, messages = scan_good_files(spark, str(table), schema)
    assert rows.count() == 2000 and messages.count() == 0
    rows, messages = scan_good_files(spark, str(tmp_path / "missing"), schema)
    assert rows.count() == 0 and rows.columns == ["id", "v"] and messages.count() == 1


def test_scan_or_empty(spark, tmp_path):
    from tabrisk.sources.tables import scan_or_empty
    df, msg = scan_or_empty(spark, str(tmp_path / "missing"), "a long")
    assert df.count() == 0 and msg.startswith("read failed")


@pytest.mark.parametrize("missing", ["mean", "zero"])
def test_fused_prep_fit_equals_stagewise(spark, missing):
    """fit_feature_prep computes fill values and post-fill population stds in one aggregation; they must
    equal fitting the fill stage and then the scaler on the filled column."""
    from tabrisk.operators.models import fit_feature_prep
    rows = [(1, 1.0, None, "a"), (2, None, 4.0, "b"), (3, 3.0, 4.0, None), (4, 7.0, None, "a"), (5, None, 10.0, "b")]
    df = spark.createDataFrame(rows, "id long, x double, y double, c string")
    prep = fit_feature_prep(df, ["c"], ["x", "y"], keep=["id"], missing=missing)
    fill = FE.ZeroFill(inputCols=["x", "y"]) if missing == "zero" else FE.MeanFill(inputCols=["x", "y"]).fit(df)
    filled = fill.transform(df)
    ref = FE.PopulationScaler(inputCols=["x", "y"]).fit(filled)
    got = [s for s in prep.stages if isinstance(s, FE.ScalerModel)][0]
    for a, b in zip(got.getOrDefault(got.means) + got.getOrDefault(got.stds),
                    ref.getOrDefault(ref.means) + ref.getOrDefault(ref.stds)):
        assert a == pytest.approx(b, rel=1e-12, abs=1e-12)
    if missing == "mean":
        fm = [s for s in prep.stages if isinstance(s, FE.FillModel)][0]
        assert fm.getOrDefault(fm.values) == pytest.approx(fill.getOrDefault(fill.values))
