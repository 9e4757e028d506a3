"""Validation, coercion and record changes on hand-made rows (FIXTURES.md section 4)."""

import random

import pytest
from pyspark.sql import functions as F

from tabrisk.operators import changes as C
from tabrisk.operators import validate as V
from tabrisk.spec import CUSTOMER, ICU, icu_schema


def _check(spark, field, values):
    df = spark.createDataFrame([(i, field, v) for i, v in enumerate(values)], "id long, field string, value string")
    return [(r.ok, r.parsed, r.message) for r in V.validate_rows(df, ICU).orderBy("id").collect()]


def test_validate_int(spark):
    got = _check(spark, "age", ["", None, "5", "3.7", "x", "-1", "131", " 7 "])
    assert [g[0] for g in got] == [1, 1, 1, 0, 0, 0, 0, 1]
    assert got[0][1] is None and got[2][1] == 5.0
    assert got[3][2] == "bad format" and got[5][2] == "must be >= 0" and got[6][2] == "must be <= 130"


def test_validate_float(spark):
    got = _check(spark, "temp_apache", ["36.6", "25", "45", "24.9", "45.1"])
    assert [g[0] for g in got] == [1, 1, 1, 0, 0]
    assert got[3][2] == "must be >= 25" and got[4][2] == "must be <= 45"


def test_unknown_field_always_valid(spark):
    assert _check(spark, "no_such_field", ["anything"]) == [(1, None, None)]


def test_integral_and_bool(spark):
    df = spark.createDataFrame([("7.0",), ("7.5",), ("a",)], "v string")
    ok, val = V.validate_integral("v")
    assert [(r.ok, r.x) for r in df.select(ok.alias("ok"), val.alias("x")).collect()] == [
        (True, 7), (False, None), (False, None)]
    b = spark.createDataFrame([(" TRUE ",), ("false",), ("yes",)], "v string")
    ok, val = V.validate_bool("v")
    assert [(r.ok, r.x) for r in b.select(ok.alias("ok"), val.alias("x")).collect()] == [
        (True, True), (True, False), (False, None)]


def test_coerce_truncates(spark):
    df = spark.createDataFrame([("3.7", "1"), ("-3.7", ""), ("", "0")], "age string, aids string")
    got = V.coerce_update(df, ICU).collect()
    assert [r.age for r in got] == [3, -3, None]
    assert [r.aids for r in got] == [1, None, 0]
    typed = V.coerce_typed(df.select("age"), ICU).collect()
    assert [r.age for r in typed] == [3, -3, None]


def test_parse_edit_first_failure_by_position(spark):
    df = spark.createDataFrame([(1, "age", "N/A"), (1, "bmi", "abc"), (1, "temp_apache", "99"),
                                (2, "age", " 40 "), (2, "bmi", "22.5")], "id long, field string, value string")
    got = {r.id: r for r in V.parse_edit_rows(df, ICU, ["age", "bmi", "temp_apache"]).collect()}
    assert got[1].ok == 0 and got[1].first_bad_field == "bmi" and got[1].n_bad == 2
    assert got[2].ok == 1 and got[2].first_bad_field is None


def _base(spark):
    return spark.createDataFrame([(4, 50, 22.0, "F"), (5, 60, 30.0, "M"), (5, 61, 31.0, "M")],
                                 "patient_id long, age int, bmi double, gender string")


def test_update_fields(spark):
    ch = spark.createDataFrame([(4, "age", "25"), (4, "bmi", ""), (5, "age", "x"), (5, "bmi", "20"), (9, "age", "1")],
                               "id long, field string, value string")
    new, status = C.update_fields(_base(spark), ch, ICU)
    rows = {(r.patient_id, r.age): r for r in new.collect()}
    assert (4, 25) in rows and rows[(4, 25)].bmi is None and rows[(4, 25)].gender == "F"
    assert (5, 60) in rows and (5, 61) in rows  # id 5 refused: one bad field of two
    st = {r.patient_id: r.status for r in status.collect()}
    assert st == {4: "ok", 5: "refused", 9: "not found"} and status.count() == 3


def test_update_all_rows_with_id(spark):
    ch = spark.createDataFrame([(5, "bmi", "25")], "id long, field string, value string")
    new, _ = C.update_fields(_base(spark), ch, ICU)
    assert sorted(r.bmi for r in new.filter("patient_id = 5").collect()) == [25.0, 25.0]


def test_delete_rows(spark):
    new, status = C.delete_rows(_base(spark), spark.createDataFrame([(5,), (8,)], "patient_id long"), ICU)
    assert [r.patient_id for r in new.collect()] == [4]
    assert {r.patient_id: r.status for r in status.collect()} == {5: "ok", 8: "not found"}
    assert status.count() == 2  # one status row per requested id, although id 5 occurs twice in the table


def test_replace_rows_status_per_id(spark):
    new = spark.createDataFrame([(5, 70, 20.0, "F"), (8, 71, 21.0, "M")], "patient_id long, age int, bmi double, gender string")
    out, status = C.replace_rows(_base(spark), new, ICU)
    assert sorted((r.patient_id, r.age) for r in out.collect()) == [(4, 50), (5, 70)]
    assert sorted((r.patient_id, r.status) for r in status.collect()) == [(5, "ok"), (8, "refused")]


def test_insert_with_defaults(spark):
    base = _base(spark)
    new = spark.createDataFrame([(1, 4, 33), (2, 70, None), (3, None, 40), (4, None, 41), (5, 70, 42)],
                                "row_no long, patient_id long, age int")
    out, status = C.insert_with_defaults(base, new, ICU)
    st = {r.row_no: (r.status, r.patient_id) for r in status.collect()}
    assert st[1][0] == "refused" and st[2] == ("ok", 70) and st[5][0] == "refused"
    assert st[3] == ("ok", 71) and st[4] == ("ok", 72)
    r = out.filter("patient_id = 71").first()
    assert r.age == 40 and r.gender == "Unknown" and r.bmi is None


def test_insert_rows_ids(spark):
    new = spark.createDataFrame([(30,), (31,)], "age int")
    out, _ = C.insert_rows(_base(spark), new, ICU, [F.col("age").asc()])
    assert sorted(r.patient_id for r in out.collect()) == [4, 5, 5, 6, 7]


def _feed(spark, events):
    return spark.createDataFrame(events, "id long, seq long, action string, field string, value string")


def test_edit_feed_cases(spark):
    base = spark.createDataFrame([(i, 50) for i in range(1, 7)], "patient_id long, age int")
    ev = [
        (1, 1, "start", "age", None), (1, 2, "set", "age", "30"), (1, 3, "set", "age", "31"), (1, 4, "save", "age", None),
        (2, 1, "start", "age", None), (2, 2, "set", "age", "999"), (2, 3, "save", "age", None),
        (3, 1, "start", "age", None), (3, 2, "set", "age", "30"), (3, 3, "cancel", None, None),
        (4, 1, "start", "age", None), (4, 2, "set", "age", "30"), (4, 3, "save", "age", None),
        (4, 4, "cancel", None, None),
        (5, 1, "start", "age", None), (5, 2, "set", "age", "33"), (5, 3, "end", "age", None),
        (5, 4, "save", "age", None),
        (6, 1, "set", "age", "20"),
    ]
    new, status = C.apply_edit_feed(base, _feed(spark, ev), ICU)
    got = {r.patient_id: r.age for r in new.collect()}
    assert got == {1: 31, 2: 50, 3: 50, 4: 30, 5: 33, 6: 50}
    st = {(r.id, r.seq): r.status for r in status.collect()}
    assert st[(6, 1)] == "no open session" and st[(2, 2)] == "must be <= 130"


def test_pending_edits(spark):
    ev = [(1, 1, "start", "age", None), (1, 2, "set", "age", "30"),
          (2, 1, "start", "age", None), (2, 2, "set", "age", "30"), (2, 3, "end", "age", None),
          (3, 1, "start", "age", None), (3, 2, "cancel", None, None)]
    got = {r.id: r for r in C.pending_edits(_feed(spark, ev), ICU).collect()}
    assert got[1].is_editing == 1 and got[1].editing_field == "age" and got[1].n_unsaved == 1
    assert got[2].is_editing == 0 and got[2].n_unsaved == 1
    assert 3 not in got


def test_icu_schema():
    s = icu_schema()
    assert len(s.fields) == 85
    assert s["age"].metadata["rule"]["max"] == 130 and s["gender"].metadata["values"] == ["F", "M", "Unknown"]
    assert len(ICU.numeric_features) == 72


def test_ids_on_empty_table_start_at_one(spark):
    empty = spark.createDataFrame([], "patient_id long, age int")
    assert C.next_id(empty, ICU) == 1
    out, _ = C.insert_rows(empty, spark.createDataFrame([(30,), (31,)], "age int"), ICU, [F.col("age").asc()])
    assert sorted(r.patient_id for r in out.collect()) == [1, 2]


def test_large_integers_survive_and_overflow_is_refused(spark):
    from tabrisk.functions import trunc_int
    texts = ["3000000000", "-3000000000.9", "9007199254740993", "9223372036854775807", "9223372036854775808", "x", "", " 12 ", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.v for r in df.select(trunc_int("t").alias("v")).collect()]
    assert got == [3000000000, -3000000000, 9007199254740993, 9223372036854775807, None, None, None, 12, 7]
    base = spark.createDataFrame([(1, "a", 5, 1.0, "x")], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    from tabrisk.spec import FieldRule, TableSpec
    spec = TableSpec(name="t", id_col="c_custkey", rules={"c_nationkey": FieldRule("int")}, list_cols=("c_custkey", "c_acctbal", "c_mktsegment", "c_name"))
    for value, status, kept in (("3000000000", "ok", 3000000000), ("9223372036854775808", "refused", 5)):
        new, st = C.update_fields(base, spark.createDataFrame([(1, "c_nationkey", value)], "id long, field string, value string"), spec)
        assert st.first().status == status and new.first().c_nationkey == kept


def test_repeated_ids_give_one_row_in_a_lookup(spark):
    from tabrisk.sources.tables import key_lookup
    df = spark.createDataFrame([(1, "b", 2, 1.0, "x"), (1, "a", 9, 2.0, "y"), (2, "c", 1, 0.0, "z")], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    got = key_lookup(df, spark.createDataFrame([(1,), (3,), (1,)], "key long"), CUSTOMER).orderBy("c_custkey").collect()
    assert [(r.c_custkey, r.found, r.c_name) for r in got] == [(1, 1, "a"), (3, 0, None)]


def test_search_takes_nan_for_missing(spark):
    from tabrisk.operators import query as Q
    df = spark.createDataFrame([(1, "a", 1, float("nan"), "x"), (2, "b", 1, 50.0, "x"), (3, "c", 1, None, "x"), (4, "d", 1, 5.0, "x")], "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string")
    ids = lambda **k: sorted(r.c_custkey for r in Q.search_multi(df, CUSTOMER, Q.Criteria(**k)).collect())
    assert ids(lo=10.0, strict=True) == [2] and ids(hi=10.0, strict=True) == [4]
    assert ids(lo=10.0) == [1, 2, 3] and ids(hi=10.0) == [1, 3, 4] and ids(lo=1.0, hi=10.0) == [1, 3, 4]


def test_mean_fill_keeps_fractions_on_integer_columns(spark):
    from tabrisk.operators.features import MeanFill
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, None)], "id long, x int")
    got = {r.id: r.x for r in MeanFill(inputCols=["x"]).fit(df).transform(df).collect()}
    assert got[4] == pytest.approx(5 / 3) and got[1] == 1.0


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_sessions_match_a_replay(spark, ranges):
    # one id with most events, so that it spans ranges and batches; ids that begin and end at the bounds; actions at random
    rng = random.Random(ranges)
    ev = [(i, q, rng.choice(["start", "set", "end", "save", "cancel", None]), "age", str(q)) for i, n in
          ((1, 30), (2, 25_000), (3, 1), (4, 500), (5, 2_000)) for q in range(n)] + [(None, 1, "start", "age", "1")]
    rng.shuffle(ev)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = {(r.id, r.seq): (r.session, r.open) for r in C._sessions(_feed(spark, ev), ICU).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, state = {}, {}
    for i, q, action, _, _ in sorted((e for e in ev if e[0] is not None), key=lambda e: e[:2]):
        session, is_open = state.get(i, (0, False))
        is_open = is_open or action == "start"
        want[i, q] = (session, is_open)
        state[i] = (session + 1, False) if action == "cancel" else (session, is_open)
    assert got == want
    assert C._sessions(_feed(spark, ev[:0]), ICU).count() == 0
