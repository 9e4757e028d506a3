"""Column profiling and type suggestion.

One scan, one path for every column. Each task reads its rows once and keeps a state of bounded size for each column:

* T1/T2: counts of values and numbers, smallest and largest number, whether all are 0 or 1, whether any has decimals;
* T3: the k + 1 smallest distinct values, numbers in numeric order before text in the order of its UTF-8 bytes (the
  last only sets the ``more`` flag);
* T4: the k values with the smallest ids. Rows without an id come first; rows that share an id go by their text.

States merge into states of the same size, so they go up a tree: up to ``FAN`` tasks into one, then all of these. What is
shuffled is a row for each task and column, whatever the number of rows or of distinct values. An empty table and
a column without values give type ``unknown`` and no values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: tasks whose states are merged in one group of the first level
FAN = 2048


class _ColumnState:
    """What a task remembers of a column: its numbers' summary, ``k_values`` smallest values, ``k_rows`` first rows."""

    def __init__(self, k_values: int, k_rows: int):
        self.k_values, self.k_rows = k_values, k_rows
        self.count = self.numbers = 0
        self.low = self.high = None
        self.binary, self.decimals = True, False
        self.values: list[tuple] = []  # (is a word, number, text), sorted
        self.rows: list[tuple] = []  # (id, text), sorted

    def add(self, ids, rank, txt, num) -> None:
        """One batch; ``rank()`` gives the dense ranks of its ids (computed once for all columns, when first needed)."""
        import numpy as np

        valid = txt.is_valid()
        n = valid.sum().as_py() or 0
        if n == 0:
            return
        self.count += n
        numbers = num.drop_null().to_numpy(zero_copy_only=False)
        if len(numbers):
            self.numbers += len(numbers)
            low, high = np.fmin.reduce(numbers), np.max(numbers)  # NaN counts as the largest number, as in Spark
            self.low = float(low if self.low is None else np.fmin(low, self.low))
            self.high = float(high if self.high is None else np.maximum(high, self.high))
            self.binary = self.binary and bool(np.isin(numbers, (0.0, 1.0)).all())
            self.decimals = self.decimals or bool((numbers != np.floor(numbers)).any())
        self._add_values(valid, txt, num)
        self._add_rows(valid, ids, rank, txt)

    def _add_values(self, valid, txt, num) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keep = valid
        if len(self.values) == self.k_values:  # only what sorts before the last one kept can matter
            word, last, text = self.values[-1]
            if word:
                keep = pc.and_(keep, pc.or_(num.is_valid(), pc.fill_null(pc.less_equal(txt, pa.scalar(text, txt.type)), False)))
            elif last == last:
                keep = pc.and_(keep, pc.fill_null(pc.less_equal(num, last), False))
            else:
                keep = num.is_valid()
        txt, num = txt.filter(keep), num.filter(keep)
        if len(txt) == 0:
            return
        codes = txt.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        first = np.unique(codes, return_index=True)[1]
        found = pa.table({"num": num.take(pa.array(first)), "txt": txt.take(pa.array(first))})
        # nulls last, NaN before them
        best = found.take(pc.sort_indices(found, sort_keys=[("num", "ascending"), ("txt", "ascending")])[:self.k_values])
        merged = {t: x for _, x, t in self.values} | dict(zip(best["txt"].to_pylist(), best["num"].to_pylist()))
        self.values = sorted(((x is None, x, t) for t, x in merged.items()), key=_value_order)[:self.k_values]

    def _add_rows(self, valid, ids, rank, txt) -> None:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        keep = valid
        if len(self.rows) == self.k_rows:
            last = self.rows[-1][0]
            early = ids.is_null() if last is None else pc.fill_null(pc.less_equal(ids, pa.scalar(last, ids.type)), True)
            keep = pc.and_(keep, early)
        at = np.flatnonzero(keep.to_numpy(zero_copy_only=False))
        if len(at) == 0:
            return
        ranks = rank()[at]
        if len(at) > self.k_rows:
            at = at[ranks <= np.partition(ranks, self.k_rows - 1)[self.k_rows - 1]]
        rows = list(zip(ids.take(pa.array(at)).to_pylist(), txt.take(pa.array(at)).to_pylist()))
        self.rows = sorted(self.rows + rows, key=lambda r: (r[0] is not None, r[0], r[1].encode()) if r[0] is not None
                           else (False, 0, r[1].encode()))[:self.k_rows]


def _value_order(v: tuple) -> tuple:
    word, x, t = v
    nan = x is not None and x != x
    return word, nan, 0.0 if word or nan else x, t.encode()


def _task_states(df: DataFrame, id_col: str, cols: Sequence[str], k_distinct: int, k_sample: int) -> DataFrame:
    """One row per (task, column): the state of that column over the task's rows."""
    inputs = [F.col(f"`{id_col}`").alias("id")]
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        num = col.cast("double") if isinstance(df.schema[c].dataType, _NUMERIC) else col.cast("string").try_cast("double")
        inputs += [col.cast("string").alias(f"t{i}"), num.alias(f"n{i}")]
    rows = df.select(*inputs)
    schema = T.StructType().add("task", "integer").add("pos", "integer").add("n_non_null", "long").add("n_num", "long") \
        .add("low", "double").add("high", "double").add("binary", "boolean").add("decimals", "boolean") \
        .add("values", T.ArrayType(T.StructType().add("word", "boolean").add("num", "double").add("txt", "string"))) \
        .add("rows", T.ArrayType(T.StructType().add("id", rows.schema["id"].dataType).add("txt", "string")))
    n_cols = len(cols)

    def summarise(batches: Iterator) -> Iterator:
        import functools

        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        states, id_type = [_ColumnState(k_distinct + 1, k_sample) for _ in range(n_cols)], None
        for batch in batches:
            ids = batch.column(0)
            id_type = ids.type
            rank = functools.cache(lambda ids=ids: pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense")
                                   .to_numpy(zero_copy_only=False))
            for i, state in enumerate(states):
                state.add(ids, rank, batch.column(1 + 2 * i), batch.column(2 + 2 * i))
        if id_type is None:
            return
        value = pa.struct([("word", pa.bool_()), ("num", pa.float64()), ("txt", pa.string())])
        row = pa.struct([("id", id_type), ("txt", pa.string())])
        arrays = [
            pa.array([TaskContext.get().partitionId()] * n_cols, pa.int32()), pa.array(range(n_cols), pa.int32()),
            pa.array([s.count for s in states], pa.int64()), pa.array([s.numbers for s in states], pa.int64()),
            pa.array([s.low for s in states], pa.float64()), pa.array([s.high for s in states], pa.float64()),
            pa.array([s.binary for s in states]), pa.array([s.decimals for s in states]),
            pa.array([[dict(zip(("word", "num", "txt"), v)) for v in s.values] for s in states], pa.list_(value)),
            pa.array([[dict(zip(("id", "txt"), r)) for r in s.rows] for s in states], pa.list_(row)),
        ]
        yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())

    return rows.mapInArrow(summarise, schema)


def _merged(states: DataFrame, keys: Sequence, k_distinct: int, k_sample: int) -> DataFrame:
    """States of a group as one state; the struct order of its lists is the order of values and of rows."""
    return states.groupBy(*keys).agg(
        F.sum("n_non_null").alias("n_non_null"), F.sum("n_num").alias("n_num"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.bool_and("binary").alias("binary"), F.bool_or("decimals").alias("decimals"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))), 1, k_distinct + 1).alias("values"),
        F.slice(F.array_sort(F.flatten(F.collect_list("rows"))), 1, k_sample).alias("rows"))


def profile_state(df: DataFrame, id_col: str, columns: Sequence[str] | None = None, k_distinct: int = 10,
                  k_sample: int = 5) -> DataFrame:
    """One row per column: column_name, pos, the merged state, and ``k`` (values listed at most)."""
    cols = list(columns or df.columns)
    states = _task_states(df, id_col, cols, k_distinct, k_sample)
    groups = _merged(states, ["pos", F.floor(F.col("task") / FAN).alias("task")], k_distinct, k_sample)
    whole = _merged(groups, ["pos"], k_distinct, k_sample)
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "pos int, column_name string")  # the schema's columns
    return F.broadcast(names).join(whole, "pos", "left").withColumn("k", F.lit(k_distinct))


def _type_columns() -> list:
    numeric = F.col("n_num") == F.col("n_non_null")
    some = F.coalesce(F.col("n_non_null"), F.lit(0)) > 0
    typ = (F.when(~some, "unknown").when(numeric & F.col("binary"), "int (binary)")
           .when(numeric & F.col("decimals"), "float").when(numeric, "int").otherwise("str"))
    return [typ.alias("suggested_type"), F.coalesce("n_non_null", F.lit(0)).cast("long").alias("n_non_null"),
            F.when(numeric, F.col("low")).alias("min_value"), F.when(numeric, F.col("high")).alias("max_value"),
            F.when(numeric & some, F.col("decimals").cast("int")).otherwise(0).alias("has_decimals")]


def _distinct_columns() -> list:
    texts = F.transform(F.slice("values", 1, F.col("k")), lambda v: v["txt"])
    return [F.when(F.size("values") > 0, F.array_join(texts, ", ")).alias("distinct_values"),
            F.coalesce((F.size("values") > F.col("k")).cast("int"), F.lit(0)).alias("more")]


def _sample_column():
    return F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: r["txt"]), ", ")).alias("sample_values")


def profile_type(state: DataFrame) -> DataFrame:
    """T1 + T2: suggested type, non-null count, min, max, has_decimals per column."""
    return state.select("column_name", "pos", *_type_columns())


def profile_distinct(state: DataFrame) -> DataFrame:
    """First k distinct values (numbers in numeric order, then text) of each column with values, ``more`` flag."""
    return state.select("column_name", *_distinct_columns()).filter(F.col("distinct_values").isNotNull())


def profile_sample(state: DataFrame) -> DataFrame:
    """T4: first k non-null values in record order (by id) of each column with values."""
    return state.select("column_name", _sample_column()).filter(F.col("sample_values").isNotNull())


def profile_report(df: DataFrame, id_col: str, columns: Sequence[str] | None = None, k_distinct: int = 10,
                   k_sample: int = 5) -> DataFrame:
    """T5: one row per column with T1-T4."""
    return profile_state(df, id_col, columns, k_distinct, k_sample).select(
        "column_name", "pos", *_type_columns(), *_distinct_columns(), _sample_column())


def profile_oracle_sql(table_sql: str, id_col: str, columns: Sequence[tuple[str, bool]], k_distinct: int = 10,
                       k_sample: int = 5) -> str:
    """DuckDB form of ``profile_report``; ``columns`` = [(name, is_numeric)], ``table_sql`` a FROM item."""
    parts = []
    for i, (c, is_num) in enumerate(columns):
        num = f"CAST({c} AS DOUBLE)" if is_num else f"TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS column_name, {i} AS pos, {id_col} AS _id, CAST({c} AS VARCHAR) AS txt, "
                     f"{num} AS num FROM {table_sql}")
    long = " UNION ALL ".join(parts)
    names = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS pos" for i, (c, _) in enumerate(columns))
    return f"""
WITH lf AS (SELECT * FROM ({long}) WHERE txt IS NOT NULL),
names AS ({names}),
agg AS (
  SELECT column_name, COUNT(*) AS n_non_null, COUNT(num) AS n_num, MIN(num) AS mn, MAX(num) AS mx,
         MAX(CASE WHEN num IN (0.0, 1.0) THEN 0 ELSE 1 END) AS not_binary,
         MAX(CASE WHEN num <> floor(num) THEN 1 ELSE 0 END) AS dec
  FROM lf GROUP BY column_name),
t AS (
  SELECT n.column_name, n.pos,
         CASE WHEN a.n_non_null IS NULL THEN 'unknown'
              WHEN a.n_num = a.n_non_null AND a.not_binary = 0 THEN 'int (binary)'
              WHEN a.n_num = a.n_non_null AND a.dec = 1 THEN 'float'
              WHEN a.n_num = a.n_non_null THEN 'int'
              ELSE 'str' END AS suggested_type,
         CAST(COALESCE(a.n_non_null, 0) AS BIGINT) AS n_non_null,
         CASE WHEN a.n_num = a.n_non_null THEN a.mn END AS min_value,
         CASE WHEN a.n_num = a.n_non_null THEN a.mx END AS max_value,
         CAST(CASE WHEN a.n_num = a.n_non_null THEN a.dec ELSE 0 END AS INTEGER) AS has_decimals
  FROM names n LEFT JOIN agg a USING (column_name)),
dv AS (SELECT column_name, txt, MIN(num) AS num FROM lf GROUP BY column_name, txt),
dr AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY num ASC NULLS LAST, txt ASC) AS rn FROM dv),
d AS (SELECT column_name, string_agg(CASE WHEN rn <= {k_distinct} THEN txt END, ', ' ORDER BY rn) AS distinct_values,
             CAST(MAX(rn) > {k_distinct} AS INTEGER) AS more
      FROM dr WHERE rn <= {k_distinct + 1} GROUP BY column_name),
sr AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY _id) AS rn FROM lf),
s AS (SELECT column_name, string_agg(txt, ', ' ORDER BY rn) AS sample_values FROM sr WHERE rn <= {k_sample}
      GROUP BY column_name)
SELECT t.column_name, t.pos, t.suggested_type, t.n_non_null, t.min_value, t.max_value, t.has_decimals,
       d.distinct_values, COALESCE(d.more, 0) AS more, s.sample_values
FROM t LEFT JOIN d USING (column_name) LEFT JOIN s USING (column_name)
"""
