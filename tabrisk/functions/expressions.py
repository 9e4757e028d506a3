"""Scalar column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so that it stays inside
whole-stage code generation. ANSI mode is on by default in Spark 4, so text is never converted with a
plain ``cast``: ``try_cast`` turns a bad value into NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c) -> Column:
    """Text (or any value) to double; unparsable -> NULL."""
    return _c(c).try_cast("double")


def trunc_int(c) -> Column:
    """Number or numeric text to a 64-bit integer, truncating toward zero ('3.7' -> 3, '-3.7' -> -3).

    Text of an integer is converted exactly; NULL only for what is no number or beyond 64 bits.
    """
    text = _c(c).cast("string")
    exact = F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long"))
    return exact.otherwise(_c(c).try_cast("double").try_cast("long"))


def is_blank(c) -> Column:
    """NULL or empty text."""
    col = _c(c)
    return col.isNull() | (col.cast("string") == F.lit(""))


def nan_to_null(c) -> Column:
    col = _c(c)
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)


def normalize_nans(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column (NaN sorts above all numbers in Spark)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(nan_to_null(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def stable_hash(c, seed: int) -> Column:
    """Deterministic hex digest of a key and a seed; DuckDB computes the same ``md5(key || ':' || seed)``."""
    return F.md5(F.concat(_c(c).cast("string"), F.lit(f":{seed}")))


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(z)))


def clip_prob(p, eps: float = 1e-15) -> Column:
    return F.least(F.greatest(_c(p), F.lit(eps)), F.lit(1.0 - eps))


def fmt_decimals(c, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", _c(c))


def as_text(c) -> Column:
    return _c(c).cast("string")


def range_text(lo, hi) -> Column:
    """'a-b' text of an id range."""
    return F.concat_ws("-", _c(lo).cast("string"), _c(hi).cast("string"))
