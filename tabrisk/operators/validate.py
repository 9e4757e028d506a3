"""Validation and coercion (V3-V10), all as column expressions.

Field values to check come in long form ``(id, field, value)`` with ``value`` as text -- the shape of
an edit form or a change feed. The rules of a ``TableSpec`` become a small rule table (one row per
ruled field; its size is the schema width, never the data), joined with a broadcast hash join, so
one generic expression validates every field. No Python UDF runs per row.

Semantics (fixed by the original application):
* a field without a rule is always valid and kept as given;
* NULL or empty text is valid and becomes NULL (numbers always; text when ``allow_null``);
* an int rule needs integer text (``'3.7'`` is a format error); a float rule needs a number;
* bounds are inclusive; a ``str`` rule with a domain needs a listed value (case-sensitive).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.functions import trunc_int
from tabrisk.spec import FieldRule, TableSpec

# Fixed message texts.
MSG_FORMAT = "bad format"
MSG_MIN = "must be >= "
MSG_MAX = "must be <= "
MSG_DOMAIN = "must be one of: "
MSG_INTEGER = "must be an integer"
MSG_BOOL = "must be true or false"

INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"

RULE_SCHEMA = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("rtype", T.StringType()),
    T.StructField("rmin", T.DoubleType()), T.StructField("rmax", T.DoubleType()),
    T.StructField("allow_null", T.BooleanType()), T.StructField("domain", T.ArrayType(T.StringType())),
    T.StructField("min_text", T.StringType()), T.StructField("max_text", T.StringType()),
    T.StructField("fpos", T.IntegerType()),
])


def _num_text(x) -> str | None:
    if x is None:
        return None
    return str(int(x)) if float(x).is_integer() else str(x)


def rule_rows(spec: TableSpec, order: Sequence[str] | None = None) -> list[tuple]:
    order = list(order or spec.rules)
    rows = []
    for f, r in spec.rules.items():
        dom = list(r.values) if r.values else None
        pos = order.index(f) if f in order else len(order)
        rows.append((f, r.type, None if r.min is None else float(r.min), None if r.max is None else float(r.max),
                     r.allow_null, dom, _num_text(r.min), _num_text(r.max), pos))
    return rows


def rule_table(spark: SparkSession, spec: TableSpec, order: Sequence[str] | None = None) -> DataFrame:
    return spark.createDataFrame(rule_rows(spec, order), RULE_SCHEMA)


def _check(v: Column) -> tuple[Column, Column, Column]:
    """(ok, parsed, message) for a text value joined with its rule columns."""
    rtype, rmin, rmax = F.col("rtype"), F.col("rmin"), F.col("rmax")
    blank = v.isNull() | (v == F.lit(""))
    num = v.try_cast("double")
    int_text = v.rlike(INT_TEXT)
    parsed = (F.when(rtype == "int", F.when(int_text, num))
              .when(rtype == "float", num))
    bad_format = ((rtype == "int") & ~int_text) | ((rtype == "float") & num.isNull())
    below = rmin.isNotNull() & (parsed < rmin)
    above = rmax.isNotNull() & (parsed > rmax)
    in_domain = F.coalesce(F.array_contains(F.col("domain"), v), F.lit(False))
    bad_domain = (rtype == "str") & F.col("domain").isNotNull() & ~in_domain
    null_ok = blank & (F.col("allow_null") | rtype.isin("int", "float"))
    message = (F.when(rtype.isNull(), F.lit(None))
               .when(null_ok, F.lit(None))
               .when(bad_format, F.lit(MSG_FORMAT))
               .when(below, F.concat(F.lit(MSG_MIN), F.col("min_text")))
               .when(above, F.concat(F.lit(MSG_MAX), F.col("max_text")))
               .when(bad_domain, F.concat(F.lit(MSG_DOMAIN), F.array_join(F.col("domain"), ", "))))
    ok = message.isNull()
    out_parsed = F.when(null_ok, F.lit(None).cast("double")).otherwise(parsed)
    return ok, out_parsed, message


def validate_rows(long: DataFrame, spec: TableSpec, id_col: str = "id", field_col: str = "field",
                  value_col: str = "value") -> DataFrame:
    """V3 (+V4 when a rule has a domain): one output row per input value.

    Output: id, field, value, ok (0/1), parsed (double or NULL), message (NULL when ok).
    """
    rules = rule_table(long.sparkSession, spec)
    j = long.select(F.col(id_col).alias("id"), F.col(field_col).alias("field"),
                    F.col(value_col).cast("string").alias("value")) \
        .join(F.broadcast(rules), "field", "left")
    ok, parsed, msg = _check(F.col("value"))
    return j.select("id", "field", "value", ok.cast("int").alias("ok"), parsed.alias("parsed"),
                    msg.alias("message"))


def validate_domain(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    """V4 as a column: the value is one of a (small, fixed) domain."""
    return F.col(column).isin(list(values))


def validate_integral(v) -> tuple[Column, Column]:
    """V5: text -> number that must equal its integer part; returns (ok, int value)."""
    c = F.col(v) if isinstance(v, str) else v
    d = c.try_cast("double")
    ok = d.isNotNull() & (d == F.floor(d))
    return ok, F.when(ok, d.try_cast("long"))


def validate_bool(v) -> tuple[Column, Column]:
    """V6: text 'true'/'false' in any case; returns (ok, boolean)."""
    c = F.col(v) if isinstance(v, str) else v
    t = F.lower(F.trim(c))
    ok = t.isin("true", "false")
    return ok, F.when(ok, t == F.lit("true"))


def parse_edit_rows(long: DataFrame, spec: TableSpec, field_order: Sequence[str],
                    id_col: str = "id", field_col: str = "field", value_col: str = "value") -> DataFrame:
    """V7: a full edit form per record: trim, 'N/A' -> NULL, type check, bounds, then V3.

    One row per record: ok, the first failing field (by form position) and its message, the number
    of failing fields. "First" is the minimum position over the failing fields (``min_by``); the
    per-record group is small (one row per field of one form).
    """
    rules = rule_table(long.sparkSession, spec, field_order)
    v0 = F.trim(F.col("value"))
    v = F.when(v0 == F.lit("N/A"), F.lit(None)).otherwise(v0)
    j = long.select(F.col(id_col).alias("id"), F.col(field_col).alias("field"),
                    F.col(value_col).cast("string").alias("value")) \
        .join(F.broadcast(rules), "field", "left").withColumn("v", v)
    d = F.col("v").try_cast("double")
    rtype = F.col("rtype")
    # only 'N/A' is null in a form; empty text is refused by a typed field
    blank = F.col("v").isNull()
    typed_bad = (F.when(blank, F.lit(None))
                 .when((rtype == "int") & (d.isNull() | (d != F.floor(d))), F.lit(MSG_INTEGER))
                 .when((rtype == "bool") & ~F.lower(F.col("v")).isin("true", "false"), F.lit(MSG_BOOL))
                 .when((rtype == "float") & d.isNull(), F.lit(MSG_FORMAT))
                 .when(F.col("rmin").isNotNull() & (d < F.col("rmin")), F.concat(F.lit(MSG_MIN), F.col("min_text")))
                 .when(F.col("rmax").isNotNull() & (d > F.col("rmax")), F.concat(F.lit(MSG_MAX), F.col("max_text"))))
    in_domain = F.coalesce(F.array_contains(F.col("domain"), F.col("v")), F.lit(False))
    dom_bad = F.when((rtype == "str") & F.col("domain").isNotNull() & ~blank & (F.col("v") != "") & ~in_domain,
                     F.concat(F.lit(MSG_DOMAIN), F.array_join(F.col("domain"), ", ")))
    msg = F.coalesce(typed_bad, dom_bad)
    pos = F.coalesce(F.col("fpos"), F.lit(len(field_order)))
    checked = j.select("id", "field", pos.alias("fpos"), msg.alias("message"))
    bad = F.col("message").isNotNull()
    return checked.groupBy("id").agg(
        (F.sum(bad.cast("int")) == 0).cast("int").alias("ok"),
        F.min_by(F.when(bad, F.col("field")), F.when(bad, F.col("fpos"))).alias("first_bad_field"),
        F.min_by(F.col("message"), F.when(bad, F.col("fpos"))).alias("message"),
        F.sum(bad.cast("int")).cast("long").alias("n_bad"),
    )


def coerce_typed(df: DataFrame, spec: TableSpec) -> DataFrame:
    """V8 (read side): int-ruled fields truncated to 64-bit integers; float-ruled to double; others as stored."""
    cols = []
    for f in df.columns:
        r = spec.rules.get(f)
        if r is not None and r.type == "int":
            cols.append(trunc_int(f).alias(f))
        elif r is not None and r.type == "float":
            cols.append(F.col(f).try_cast("double").alias(f))
        else:
            cols.append(F.col(f))
    return df.select(*cols)


def coerce_update_value(rule: FieldRule | None, is_category: bool, v: Column) -> Column:
    """V9 (write side) for one field: '' -> NULL, int via float (truncating), float, category as text."""
    blank = v.isNull() | (v.cast("string") == F.lit(""))
    if rule is not None:
        if rule.type == "int":
            return F.when(blank, F.lit(None)).otherwise(trunc_int(v))
        if rule.type == "float":
            return F.when(blank, F.lit(None)).otherwise(v.try_cast("double"))
        return F.when(blank, F.lit(None)).otherwise(v.cast("string"))
    if is_category:
        return F.when(blank, F.lit(None)).otherwise(v.cast("string"))
    return v


def coerce_update(df: DataFrame, spec: TableSpec) -> DataFrame:
    """V9 over a wide change table."""
    return df.select(*[coerce_update_value(spec.rules.get(f), f in spec.categories, F.col(f)).alias(f)
                       for f in df.columns])


def coerce_flags(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Named 0/1 fields to numbers; unparsable -> NULL."""
    fl = set(flags)
    return df.select(*[(F.col(c).try_cast("double").alias(c) if c in fl else F.col(c)) for c in df.columns])

