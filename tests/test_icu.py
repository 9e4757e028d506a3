"""The ICU record table end to end: BOM CSV -> typed snapshot -> search, validation, update, scoring."""

import random

import pytest
from pyspark.sql import functions as F

from tabrisk.operators import changes as C
from tabrisk.operators import models as MD
from tabrisk.operators import query as Q
from tabrisk.sources.snapshots import SnapshotStore, ingest_csv
from tabrisk.spec import ICU, ICU_CATEGORIES, ICU_RULES, icu_schema

RECORD = 30007


def edits_for(step: int) -> dict:
    """A legal new value for every ruled or categorical field, taken from the rules themselves."""
    out = {}
    for name, rule in ICU_RULES.items():
        if name == "hospital_death":
            continue
        if rule.values:
            out[name] = rule.values[step % len(rule.values)]
        elif rule.type in ("int", "float"):
            low, high = rule.min or 0, 40 if rule.max is None else rule.max
            x = low + (high - low) * (step % 5) / 5
            out[name] = int(x) if rule.type == "int" else round(float(x), 2)
    for name, cat in ICU_CATEGORIES.items():
        out[name] = cat.values[step % len(cat.values)]
    return out


def _icu_csv(path, n=60, seed=5):
    rnd = random.Random(seed)
    schema = icu_schema()
    names = [f.name for f in schema.fields]
    lines = [",".join(n if n != "_c83" else "" for n in names)]
    for i in range(n):
        pid = 30000 + i
        vals = []
        for f in schema.fields:
            c = f.name
            if c == "patient_id":
                v = str(pid)
            elif c in ("encounter_id", "hospital_id", "icu_id"):
                v = str(1000 + i)
            elif c == "_c83":
                v = ""
            elif c in ICU_CATEGORIES:
                v = rnd.choice(ICU_CATEGORIES[c].values) if rnd.random() > 0.1 else ""
            elif c in ICU_RULES:
                r = ICU_RULES[c]
                hi = r.max if r.max is not None else 500
                x = rnd.uniform(r.min or 0, hi)
                v = str(int(x)) if r.type == "int" else f"{x:.2f}"
                if c == "hospital_death":
                    v = str(int(rnd.random() < 0.3))
                if rnd.random() < 0.08 and c != "hospital_death":
                    v = ""
            else:
                v = "" if rnd.random() < 0.1 else f"{rnd.uniform(0, 200):.1f}"
            vals.append('"' + v + '"' if "," in v else v)
        lines.append(",".join(vals))
    with open(path, "w", encoding="utf-8-sig") as fh:  # with BOM, as the original file may be
        fh.write("\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def icu(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("icu")
    _icu_csv(str(d / "patients.csv"))
    store = SnapshotStore(spark, str(d / "table"))
    assert ingest_csv(spark, str(d / "patients.csv"), store, icu_schema()) == (0, 0)
    return store


def test_ingest_typed(icu):
    df = icu.read()
    assert df.count() == 60 and len(df.columns) == 85
    assert dict(df.dtypes)["age"] == "int" and dict(df.dtypes)["bmi"] == "double"
    assert df.filter(F.col("patient_id") == RECORD).count() == 1


def test_malformed_lines_are_counted(spark, tmp_path):
    from pyspark.sql import types as T
    (tmp_path / "t.csv").write_text("a,b\n1,2\nx,3\n4,5,6\n7,8\n")
    store = SnapshotStore(spark, str(tmp_path / "t"))
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    assert ingest_csv(spark, str(tmp_path / "t.csv"), store, schema) == (0, 2)
    assert store.read().count() == 4


def test_second_writer_on_a_version_is_refused(spark, tmp_path, monkeypatch):
    from tabrisk.sources.snapshots import VersionConflict
    a = SnapshotStore(spark, str(tmp_path / "t"))
    a.commit(spark.range(3))
    b = SnapshotStore(spark, str(tmp_path / "t"))
    monkeypatch.setattr(b, "version", lambda: 0)
    a.commit(spark.range(4))
    with pytest.raises(VersionConflict):
        b.commit(spark.range(5))
    assert a.version() == 1 and a.read().count() == 4


def test_search_icu(icu):
    got = Q.search_multi(icu.read(), ICU, Q.Criteria(lo=18, hi=65, category="F"))
    rows = got.collect()
    assert all(r.gender == "F" for r in rows)
    assert all(r.age is None or r.age == 0 or 18 <= r.age <= 65 for r in rows)
    assert got.columns == ["patient_id", "age", "gender", "status"]


def as_changes(spark, pid, values):
    return spark.createDataFrame([(pid, k, None if v is None else str(v)) for k, v in values.items()], "id long, field string, value string")


@pytest.mark.parametrize("step", [1, 3])
def test_every_ruled_field_can_be_edited(spark, icu, step):
    values = edits_for(step)
    new, status = C.update_fields(icu.read(), as_changes(spark, RECORD, values), ICU)
    assert [r.status for r in status.collect()] == ["ok"]
    icu.commit(new)
    rows = icu.read()
    r = rows.filter(F.col("patient_id") == RECORD).first().asDict()
    for name, v in values.items():
        got = r[name]
        assert got == v or str(got) == str(v) or float(got) == pytest.approx(float(v)), name
    assert rows.count() == 60


def test_cleared_fields_leave_the_others(spark, icu):
    before = icu.read().filter(F.col("patient_id") == RECORD + 1).first().asDict()
    cleared = ["heart_rate_apache", "weight", "icu_type"]
    new, status = C.update_fields(icu.read(), as_changes(spark, RECORD + 1, {"heart_rate_apache": "", "weight": None, "icu_type": ""}), ICU)
    assert status.first().status == "ok"
    after = new.filter(F.col("patient_id") == RECORD + 1).first().asDict()
    assert all(after[c] is None for c in cleared)
    assert {k: v for k, v in after.items() if k not in cleared} == {k: v for k, v in before.items() if k not in cleared}


def test_icu_features_and_score(spark, icu):
    df = icu.read().filter(F.col("hospital_death").isNotNull()).withColumnRenamed("hospital_death", "label")
    prep = MD.fit_feature_prep(df, list(ICU_CATEGORIES), list(ICU.numeric_features), keep=["patient_id", "label"])
    feats = MD.feature_list(prep)
    assert feats[:72] == list(ICU.numeric_features) and len(feats) > 72
    model = MD.forest(num_trees=5, max_depth=4).fit(prep.transform(df))
    s = MD.score_batch(prep, model, df, keep=["patient_id"])
    assert s.filter((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
    # serving a record that lacks numeric columns: they are filled, not an error
    one = df.limit(1).drop("d1_glucose_max")
    assert MD.score_batch(prep, model, one, keep=["patient_id"]).count() == 1


def test_default_row(spark, icu):
    base = icu.read()
    new, status = C.insert_default_row(base, ICU)
    r = new.orderBy(F.col("patient_id").desc()).first()
    mx = base.agg(F.max("patient_id"), F.max("encounter_id")).first()
    first_hosp = base.orderBy("patient_id").first().hospital_id
    assert r.patient_id == mx[0] + 1 and r.encounter_id == mx[1] + 1 and r.hospital_id == first_hosp
    assert r.gender == "Unknown" and r.icu_type == "MICU" and r.icu_stay_type == "admit" and r.age is None
    _, st = C.insert_default_row(base, ICU, id_value=RECORD)
    assert st.first().status == "refused"


def test_search_labels(icu):
    df = icu.read()
    n_f = df.filter(F.col("gender") == "F").count()
    assert Q.search_multi(df, ICU, Q.Criteria(category="女")).count() == n_f
    assert Q.search_multi(df, ICU, Q.Criteria(category="女", use_labels=False)).count() == 0
    assert Q.search_multi(df, ICU, Q.Criteria(category="全部")).count() == df.count()
