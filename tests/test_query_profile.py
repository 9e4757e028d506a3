"""Edge rows of FIXTURES.md section 4: search, sort, samples, profile."""

import math

import pytest
from pyspark.sql import functions as F

from tabrisk.operators import profile as P
from tabrisk.operators import query as Q
from tabrisk.spec import ICU, TableSpec


def _ages(spark):
    rows = [(1, None, "F"), (2, float("nan"), "M"), (3, 0.0, "F"), (4, 17.0, None), (5, 18.0, "F"), (6, 65.0, "M"),
            (7, 66.0, "F")]
    df = spark.createDataFrame(rows, "patient_id long, age double, gender string")
    from tabrisk.functions import normalize_nans
    return normalize_nans(df)


def test_search_range_keeps_missing_and_zero(spark):
    got = Q.search_multi(_ages(spark), ICU, Q.Criteria(lo=18, hi=65))
    assert sorted(r.patient_id for r in got.collect()) == [1, 2, 3, 5, 6]
    assert set(got.columns) == {"patient_id", "age", "gender", "status"}
    assert {r.status for r in got.collect()} == {"存活"}


def test_search_strict(spark):
    got = Q.search_multi(_ages(spark), ICU, Q.Criteria(lo=18, hi=65, strict=True))
    assert sorted(r.patient_id for r in got.collect()) == [5, 6]


def test_search_id_is_text_and_category_exact(spark):
    df = spark.createDataFrame([(25312, 40.0, "F"), (7, 40.0, "M"), (8, 40.0, None)],
                               "patient_id long, age double, gender string")
    for text, want in (("25312", [25312]), ("025312", []), ("25312.0", [])):
        assert [r.patient_id for r in Q.search_multi(df, ICU, Q.Criteria(id_text=text)).collect()] == want
    assert [r.patient_id for r in Q.search_multi(df, ICU, Q.Criteria(category="F")).collect()] == [25312]
    assert Q.search_multi(df, ICU, Q.Criteria(category=Q.ALL)).count() == 3


def test_search_predicate_is_pushed_to_parquet(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 90), "F" if i % 2 else "M") for i in range(200)],
                               "patient_id long, age double, gender string")
    df.write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    q = Q.search_multi(spark.read.parquet(str(tmp_path / "t")), ICU, Q.Criteria(lo=18, hi=65, category="F", strict=True))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(gender,F)" in plan and "GreaterThanOrEqual(age" in plan


def test_sort_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, None), (4, 9.0)], "patient_id long, age double")
    asc = Q.sort_list_ranked(df, "age", True, "patient_id").orderBy("pos").collect()
    assert [r.patient_id for r in asc] == [3, 2, 4, 1]
    desc = Q.sort_list_ranked(df, "age", False, "patient_id").orderBy("pos").collect()
    assert [r.age for r in desc] == [10.0, 9.0, 9.0, None]
    assert [r.pos for r in desc] == [1, 2, 3, 4]


def test_ranked_is_consecutive_over_many_partitions(spark):
    from tabrisk.plans.ordering import ranked
    df = spark.range(0, 5000).select((F.col("id") % 97).alias("k"), F.col("id"))
    for n in (1, 13, None):
        r = ranked(df, [F.col("k").asc(), F.col("id").asc()], "rk", partitions=n)
        got = [x.rk for x in r.orderBy("k", "id").collect()]
        assert got == list(range(1, 5001))
    assert ranked(df.limit(0), [F.col("id").asc()], "rk").count() == 0


def test_cumulative_paths_agree(spark):
    from tabrisk.plans.ordering import cumulative
    df = spark.range(0, 3000).select((F.col("id") % 11).alias("g"), F.col("id"), (F.col("id") % 7).alias("v"))
    order = [F.col("g").asc(), F.col("id").desc()]
    a = {r.id: r.v_cum for r in cumulative(df, order, ["v"], partitions=9).collect()}
    b = {r.id: r.v_cum for r in cumulative(df, order, ["v"]).collect()}
    assert a == b and max(a.values()) == sum(i % 7 for i in range(3000))


def test_sample_n_is_exact_for_any_size(spark):
    """The result is always the n smallest (hash, id), with repeated and null ids too."""
    df = spark.range(0, 3000).select(F.when(F.col("id") % 50 != 3, F.col("id") - F.col("id") % 4).alias("k"), "id")
    h = df.withColumn("_h", F.md5(F.concat(F.col("k").cast("string"), F.lit(":42"))))
    ordered = [r.k for r in h.orderBy(F.col("_h").asc_nulls_first(), F.col("k").asc_nulls_first()).collect()]
    for n in (1, 40, 61, 1000, 2999, 3000, 5000):
        got = [r.k for r in Q.sample_n(df, "k", n).collect()]
        assert sorted(got, key=str) == sorted(ordered[:n], key=str)
    assert Q.sample_n(df.limit(0), "k", 5).count() == 0


def test_sample_per_class(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(100)], "k long, y int")
    got = Q.sample_per_class(df, "k", "y", 4).groupBy("y").count().collect()
    assert sorted((r.y, r["count"]) for r in got) == [(0, 4), (1, 4), (2, 4)]


def test_profile_types(spark):
    rows = []
    for i in range(12):
        rows.append((i, None, i % 2, None if i == 3 else i % 2, i % 3 + 1, 1.5 if i % 2 else 2.0,
                     "a" if i == 0 else "1", str(i % 2 + 1), str(i)))
    schema = ("id long, all_null double, bin int, bin_null int, ints int, floats double, mixed string, "
              "numtext string, many string")
    df = spark.createDataFrame(rows, schema)
    cols = ["all_null", "bin", "bin_null", "ints", "floats", "mixed", "numtext", "many"]
    rep = {r.column_name: r for r in P.profile_report(df, "id", cols).collect()}
    assert rep["all_null"].suggested_type == "unknown"
    assert rep["bin"].suggested_type == "int (binary)"
    assert rep["bin_null"].suggested_type == "int (binary)"
    assert rep["ints"].suggested_type == "int" and rep["ints"].min_value == 1 and rep["ints"].max_value == 3
    assert rep["floats"].suggested_type == "float" and rep["floats"].has_decimals == 1
    assert rep["mixed"].suggested_type == "str" and rep["mixed"].min_value is None
    assert rep["numtext"].suggested_type == "int"
    assert rep["many"].more == 1
    assert rep["many"].distinct_values == "0, 1, 2, 3, 4, 5, 6, 7, 8, 9"  # numeric order, not text order
    assert rep["bin"].sample_values == "0, 1, 0, 1, 0"


def test_list_view_constant_for_missing_column(spark):
    spec = TableSpec(name="t", id_col="k", list_cols=("k", "v", "c", "status"), list_defaults={"status": "x"})
    df = spark.createDataFrame([(1, 2.0, "a")], "k long, v double, c string")
    assert Q.list_view(df, spec).first().status == "x"


def test_display_format(spark):
    df = spark.createDataFrame([(1, 36.555, None, "F")], "patient_id long, temp_apache double, bmi double, gender string")
    r = Q.display_format(df, ICU).first()
    assert (r.patient_id, r.bmi, r.gender) == ("1", "N/A", "F")
    assert r.temp_apache in ("36.56", "36.55")


def brute_profile(rows, k_distinct=10, k_sample=5):
    """(distinct_values, more, sample_values) of one column from its (id, text, number) rows."""
    def order(v):
        word, nan = v[1] is None, v[1] is not None and math.isnan(v[1])
        return word, nan, 0.0 if word or nan else v[1], v[0].encode()
    values = [t for t, _ in sorted({t: x for _, t, x in rows if t is not None}.items(), key=order)]
    firsts = [t for i, t in sorted(((i, t) for i, t, _ in rows if t is not None), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))]
    return (", ".join(values[:k_distinct]) or None, int(len(values) > k_distinct), ", ".join(firsts[:k_sample]) or None)


def number(text):
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_profile_matches_brute_force(spark, order):
    # many distinct numbers with a hot smallest one, words with shared prefixes and multi-byte letters, numbers as
    # text, numbers mixed with words, repeated and missing ids, several batches and tasks
    rows = []
    for j in range(30000):
        i = {"up": j, "down": 29999 - j, "mixed": j * 7919 % 30000}[order]
        rows.append((None if i % 9973 == 5 else i // 3, 5.0 if i % 3 == 0 else float(i), "zz" if i % 3 == 0 else f"wort-\u00e4{i:06d}",
                     str(i * 7 % 5003), str(i % 4) if i % 2 else f"w{i}", None if i % 2 else "\U0001f600" if i % 5 else "\uffff"))
    cols = ["x", "w", "n", "m", "h"]
    df = spark.createDataFrame(rows, "id long, x double, w string, n string, m string, h string").repartition(5)
    got = {r.column_name: (r.distinct_values, r.more, r.sample_values) for r in P.profile_report(df, "id", cols).collect()}
    for c, name in enumerate(cols, 1):
        text = [None if r[c] is None else str(r[c]) for r in rows]
        assert got[name] == brute_profile([(r[0], t, number(t)) for r, t in zip(rows, text)]), name


def test_profile_odd_input(spark):
    schema = "id long, `a.b` double, s string, k string"
    cols = ["a.b", "s", "k"]
    empty = {r.column_name: r for r in P.profile_report(spark.createDataFrame([], schema), "id", cols).collect()}
    assert [empty[c].suggested_type for c in cols] == ["unknown"] * 3 and empty["s"].distinct_values is None
    rows = [(1, float("nan"), "", None), (1, 2.0, "x" * 1_000_000, None), (None, float("inf"), "NaN", None), (1, 2.0, "", None)]
    got = {r.column_name: r for r in P.profile_report(spark.createDataFrame(rows, schema), "id", cols).collect()}
    assert (got["a.b"].distinct_values, got["a.b"].n_non_null) == ("2.0, Infinity, NaN", 4)
    assert got["s"].distinct_values == "NaN, , " + "x" * 1_000_000 and got["s"].sample_values.startswith("NaN, , , x")
    assert got["k"].suggested_type == "unknown" and got["k"].sample_values is None
    state = P.profile_state(spark.createDataFrame(rows, schema).repartition(4), "id", cols, 2, 2)
    assert {r.column_name: (r.distinct_values, r.more) for r in P.profile_distinct(state).collect()}["a.b"] == ("2.0, Infinity", 1)
