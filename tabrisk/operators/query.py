"""Listing, search, projections, sort and sampling.

All functions take and return lazy DataFrames. Predicates are plain comparisons on the stored
columns so that Catalyst can push their sargable parts into the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.functions import fmt_decimals, stable_hash
from tabrisk.plans.ordering import ranked
from tabrisk.spec import TableSpec

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

# the "no restriction" entry of the category picker
ALL = "ALL"


def list_view(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The four list columns; a column missing from the table shows its constant default."""
    cols = []
    for c in spec.list_cols:
        if c in df.columns:
            cols.append(F.col(c))
        else:
            cols.append(F.lit(spec.list_defaults.get(c, "")).alias(c))
    return df.select(*cols)


@dataclass(frozen=True)
class Criteria:
    """Optional search criteria (P2). Empty / None means "not set"."""

    id_text: str | None = None
    lo: float | None = None
    hi: float | None = None
    category: str | None = None
    # strict=False keeps the original behaviour: a missing or zero value passes both bounds
    strict: bool = False
    # map a search-box label to its stored code (the original compares the label itself, so a set
    # gender never matches; use_labels=False reproduces that)
    use_labels: bool = True


def id_predicate(id_col: str, text: str, schema: T.StructType) -> Column:
    """Ids are compared as text: '025312' and '25312.0' do not match 25312. On an integer column the one number
    whose text it is goes to the scan as ``id = n``; any other text matches nothing."""
    if isinstance(schema[id_col].dataType, _INTEGRAL):
        canonical = text.lstrip("-").isdecimal() and text.isascii() and str(int(text)) == text if text else False
        return F.col(id_col) == F.lit(int(text)) if canonical and abs(int(text)) < 2**63 else F.lit(False)
    return F.col(id_col).cast("string") == F.lit(text)


def search_predicate(spec: TableSpec, crit: Criteria, schema: T.StructType) -> Column:
    idc, rng, cat, _ = spec.list_cols
    parts: list[Column] = []
    if crit.id_text:
        parts.append(id_predicate(idc, crit.id_text.strip(), schema))
    r = F.col(rng)
    # NaN, which files not written by us may hold, counts as missing (it compares above every number)
    nan = F.isnan(r) if isinstance(schema[rng].dataType, (T.DoubleType, T.FloatType)) else F.lit(False)
    if crit.lo is not None:
        p = r >= F.lit(float(crit.lo))
        parts.append(p & ~nan if crit.strict else (r.isNull() | (r == 0) | p))
    if crit.hi is not None:
        p = r <= F.lit(float(crit.hi))
        parts.append(p if crit.strict else (r.isNull() | nan | (r == 0) | p))
    if crit.category and crit.category not in (ALL, spec.all_label):
        code = spec.category_labels.get(crit.category, crit.category) if crit.use_labels else crit.category
        parts.append(F.col(cat) == F.lit(code))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def search_multi(df: DataFrame, spec: TableSpec, crit: Criteria) -> DataFrame:
    """Conjunction of the set criteria, then the list projection."""
    return list_view(df.filter(search_predicate(spec, crit, df.schema)), spec)


def sort_keys(df: DataFrame, column: str, ascending: bool, id_col: str) -> list[Column]:
    """O1 order: numbers as numbers, text as text; missing first ascending, last descending; id breaks ties."""
    c = F.col(column)
    key = c.asc_nulls_first() if ascending else c.desc_nulls_last()
    tie = F.col(id_col).asc() if ascending else F.col(id_col).desc()
    return [key, tie] if column != id_col else [key]


def sort_list(df: DataFrame, column: str, ascending: bool, id_col: str) -> DataFrame:
    return df.orderBy(*sort_keys(df, column, ascending, id_col))


def sort_list_ranked(df: DataFrame, column: str, ascending: bool, id_col: str,
                     rank_col: str = "pos") -> DataFrame:
    """O1 with the position as a column (global, distributed rank; see ``plans.ordering``)."""
    return ranked(df, sort_keys(df, column, ascending, id_col), rank_col)


def drop_columns(df: DataFrame, cols, strict: bool = False) -> DataFrame:
    """Drop columns; ``strict`` fails when one is absent (the incremental path does)."""
    if strict:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"columns not found: {missing}")
    return df.drop(*cols)


def watermark_filter(df: DataFrame, id_col: str, last_id) -> DataFrame:
    """P5: rows with an id above the high-water mark (a pushed-down range filter)."""
    mark = last_id if isinstance(last_id, Column) else F.lit(last_id)
    return df.filter(F.col(id_col) > mark)


def class_filter(df: DataFrame, label: str | Column, value) -> DataFrame:
    """Rows of one label class."""
    c = F.col(label) if isinstance(label, str) else label
    return df.filter(c == F.lit(value))


def display_format(df: DataFrame, spec: TableSpec, digits: int = 2, missing: str = "N/A") -> DataFrame:
    """Every column as display text; floats to ``digits`` decimals, NULL as ``missing``."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        rule = spec.rules.get(f.name)
        is_float = isinstance(f.dataType, (T.DoubleType, T.FloatType)) or (rule is not None and rule.type == "float")
        txt = fmt_decimals(c.try_cast("double"), digits) if is_float else c.cast("string")
        # format_string renders NULL as the text 'null', so test the value, not the text
        cols.append(F.when(c.isNull(), F.lit(missing)).otherwise(txt).alias(f.name))
    return df.select(*cols)


def display_caption(spec: TableSpec, df: DataFrame) -> DataFrame:
    """P7 captions: one row per column, ``'field (type)'`` with the rule type or the stored type."""
    rows = []
    for f in df.schema.fields:
        t = spec.rules[f.name].type if f.name in spec.rules else f.dataType.simpleString()
        rows.append((f.name, f"{f.name} ({t})"))
    return df.sparkSession.createDataFrame(rows, "field string, caption string")


def column_group(df: DataFrame, spec: TableSpec, group: str) -> DataFrame:
    """The columns of a named group, in group order (absent ones skipped)."""
    return df.select(*[c for c in spec.group(group) if c in df.columns])


def threshold_label(prob, threshold: float = 0.5) -> Column:
    """Predicted class = probability strictly above the threshold."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return (p > F.lit(threshold)).cast("int")


def topk(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """O2: first n by an order (TakeOrderedAndProject: per-partition top-n, no full sort)."""
    return df.orderBy(*order).limit(n)


# hex digits of the hash that the bucket counts of a sample go by: at most 16 ** 3 counts reach the driver
PREFIX = 3


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """O3: exactly n rows without replacement (all rows if n >= count), deterministic by seed.

    Rows are ordered by ``md5(id:seed)`` and the n smallest are kept. The rows are counted by the first digits
    of their hash; every bucket below the boundary is kept whole, and the bucket that holds the boundary is
    ranked with the distributed method. So no task and not the driver holds n rows, whatever n is.
    """
    if n <= 0:
        raise ValueError("n must be a positive integer")
    return smallest_by_hash(df.withColumn("_h", stable_hash(id_col, seed)), "_h", id_col, n).drop("_h")


def smallest_by_hash(df: DataFrame, hcol: str, id_col: str, n: int) -> DataFrame:
    """The n rows with the smallest (hash, id). A null hash (of a null id) comes first."""
    pre = F.coalesce(F.substring(F.col(hcol), 1, PREFIX), F.lit(""))
    acc, boundary = 0, None
    for r in df.groupBy(pre.alias("_p")).count().orderBy("_p").collect():
        if acc + r["count"] >= n:
            boundary = r["_p"]
            break
        acc += r["count"]
    if boundary is None:
        return df
    inside = ranked(df.filter(pre == F.lit(boundary)), [F.col(hcol).asc_nulls_first(), F.col(id_col).asc_nulls_first()], "_r")
    return df.filter(pre < F.lit(boundary)).unionByName(inside.filter(F.col("_r") <= n - acc).drop("_r"))


# ranges of ids that are counted at a time: so many counts reach the driver in a pass, and a pass narrows the ids by that factor
ID_RANGES = 1024


def oldest_n(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows with the smallest ids (all if there are fewer), by distributed selection on the id column alone.

    The ids' span is cut into equal ranges whose rows are counted; the range that holds the n-th smallest id is cut again,
    until a range ends at it or is one id. Seven passes are enough for 64 bits, each an aggregation of one column that skips
    what lies outside its range. The rows themselves are read once, by ``id <= bound``, which goes to the scan; nothing is
    sorted, ranked or stored. Of rows that repeat the last id as many stay as fit. Rows without an id are not taken.
    """
    if n <= 0:
        raise ValueError("n must be a positive integer")
    idc = F.col(f"`{id_col}`")
    if not isinstance(df.schema[id_col].dataType, _INTEGRAL):
        r = ranked(df.filter(idc.isNotNull()), [idc.asc()], "_rank")
        return r.filter(F.col("_rank") <= n).drop("_rank")
    span = df.agg(F.min(idc).alias("lo"), F.max(idc).alias("hi"), F.count(idc).alias("n")).first()
    if span["n"] <= n:
        return df.filter(idc.isNotNull())
    lo, hi, need = int(span["lo"]), int(span["hi"]), n
    while lo < hi:
        width = -(-(hi - lo + 1) // ID_RANGES)
        number = F.expr(f"(CAST(`{id_col}` AS DECIMAL(20, 0)) - CAST('{lo}' AS DECIMAL(20, 0))) DIV {width}").alias("b")
        counts = df.filter((idc >= F.lit(lo)) & (idc <= F.lit(hi))).groupBy(number).agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect()
        for r in counts:
            if r["c"] >= need:
                break
            need -= r["c"]
        lo, hi = lo + r["b"] * width, min(hi, lo + (r["b"] + 1) * width - 1)
        if r["c"] == need:
            return df.filter(idc <= F.lit(hi))
    below = df.filter(idc < F.lit(lo))
    return below.unionByName(df.filter(idc == F.lit(lo)).limit(need))


def sample_per_class(df: DataFrame, id_col: str, label: str, n: int, seed: int = 42) -> DataFrame:
    """N rows per label class by hash order (window top-k per class -> WindowGroupLimit)."""
    w = Window.partitionBy(label).orderBy(stable_hash(id_col, seed), F.col(id_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
