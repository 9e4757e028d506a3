"""Feature preparation (F1, F2, F4-F6) as Spark ML stages: fit once, apply everywhere.

The original had five slightly different preparation paths (training, two serving paths, incremental);
here one ``Pipeline`` of these stages is fitted once and the fitted ``PipelineModel`` is applied for
training, batch scoring, streaming scoring and incremental learning alike.

Fitting collects only parameters to the driver: per-column category lists (bounded by
``max_categories``), means and population standard deviations (one number per column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def dummy_name(col: str, value: str) -> str:
    """Name of the 0/1 column of one category value (``<column>_<value>``)."""
    return f"{col}_{value}"


class _ColsParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "input columns", typeConverter=TypeConverters.toListString)

    def getInputCols(self) -> list[str]:
        return self.getOrDefault(self.inputCols)


class FillUnknown(Transformer, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """NULL category -> 'Unknown'."""

    value = Param(Params._dummy(), "value", "fill text", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, value: str = UNKNOWN):
        super().__init__()
        self._setDefault(value=UNKNOWN, inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [c for c in self.getInputCols() if c in df.columns]
        return df.fillna(self.getOrDefault(self.value), subset=cols) if cols else df


class OneHot(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """one 0/1 column per (column, value seen in fit), no reference level dropped.

    Fit: one job, all columns unpivoted and de-duplicated together (partial aggregation per map task),
    ``maxCategories`` (0: no limit) refuses columns with more values where a caller wants that. Apply: plain CASE expressions; a value
    not seen in fit gives zeros in every column of its block. The source column is dropped.
    """

    maxCategories = Param(Params._dummy(), "maxCategories", "largest accepted domain",
                          typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, maxCategories: int = 0):
        super().__init__()
        self._setDefault(inputCols=[], maxCategories=0)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "OneHotModel":
        cols = self.getInputCols()
        limit = self.getOrDefault(self.maxCategories)
        long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                             for c in cols])).alias("e")).select("e.c", "e.v")
        # distinct (column, value) pairs (partial aggregation per map task). The fitted encoder is made of
        # them, one output column each, so it is as large as the model itself; with a limit the driver receives
        # limit + 1 values per column at most (a top-k window, planned as WindowGroupLimit)
        pairs = long.filter(F.col("v").isNotNull()).distinct()
        if limit:
            w = Window.partitionBy("c").orderBy("v")
            pairs = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit + 1).drop("_r")
        rows = pairs.collect()
        cats: dict[str, list[str]] = {c: [] for c in cols}
        for r in rows:
            cats[r["c"]].append(r["v"])
        too_big = [c for c in cols if limit and len(cats[c]) > limit]
        if too_big:
            raise ValueError(f"one-hot columns with more than {limit} values: {too_big}")
        flat = []
        for c in cols:
            for v in sorted(cats[c]):
                flat += [c, v]
        return OneHotModel(inputCols=cols, categories=flat)


class OneHotModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    categories = Param(Params._dummy(), "categories", "flat [col, value, col, value, ...]",
                       typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, categories: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[], categories=[])
        self._set(**self._input_kwargs)

    def pairs(self) -> list[tuple[str, str]]:
        flat = self.getOrDefault(self.categories)
        return [(flat[i], flat[i + 1]) for i in range(0, len(flat), 2)]

    def outputCols(self) -> list[str]:
        """``<column>_<value>``; Spark resolves names case-insensitively, so a value that differs from an
        earlier one only in case (e.g. 'Undefined Diagnoses' / 'Undefined diagnoses') gets a ``~2`` suffix."""
        seen: dict[str, int] = {}
        out = []
        for c, v in self.pairs():
            name = dummy_name(c, v)
            k = name.lower()
            seen[k] = seen.get(k, 0) + 1
            out.append(name if seen[k] == 1 else f"{name}~{seen[k]}")
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        dummies = [F.when(F.col(c) == F.lit(v), 1).otherwise(0).cast("int").alias(name)
                   for (c, v), name in zip(self.pairs(), self.outputCols())]
        keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
        return df.select(*keep, *dummies)


class ZeroFill(Transformer, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """the serving path's literal zero fill of missing numbers."""

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols = [c for c in self.getInputCols() if c in df.columns]
        return df.fillna(0, subset=cols) if cols else df


class MeanFill(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """F4 fallback: missing numbers -> column mean of the fit data (mean of an all-NULL column: 0)."""

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "FillModel":
        cols = self.getInputCols()
        r = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
        return FillModel(inputCols=cols, values=[float(r[c]) if r[c] is not None else 0.0 for c in cols])


class FillModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    values = Param(Params._dummy(), "values", "fill value per column", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None, values: Sequence[float] | None = None):
        super().__init__()
        self._setDefault(inputCols=[], values=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fills = dict(zip(self.getInputCols(), self.getOrDefault(self.values)))
        # an integer column becomes double first, or the mean would be cut to an integer
        return df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(fills[c]))).alias(c) if c in fills
                           else F.col(f"`{c}`") for c in df.columns])


class PopulationScaler(Estimator, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population std; a zero-variance column becomes 0.

    Spark ML's ``StandardScaler`` divides by the sample std (n - 1); the original divides by the
    population std, so this stage computes ``avg`` and ``stddev_pop`` in one aggregation.
    """

    @keyword_only
    def __init__(self, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(inputCols=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ScalerModel":
        cols = self.getInputCols()
        aggs = []
        for c in cols:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
        r = df.agg(*aggs).first()
        return ScalerModel(inputCols=cols, means=[float(r[f"m_{c}"] or 0.0) for c in cols],
                           stds=[float(r[f"s_{c}"] or 0.0) for c in cols])


class ScalerModel(Model, _ColsParams, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "population stds", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, means=None, stds=None):
        super().__init__()
        self._setDefault(inputCols=[], means=[], stds=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        stats = {c: (m, s) for c, m, s in zip(self.getInputCols(), self.getOrDefault(self.means),
                                              self.getOrDefault(self.stds))}
        out = []
        for c in df.columns:
            if c in stats:
                m, s = stats[c]
                x = F.col(c).cast("double")
                z = (x - F.lit(m)) * F.lit(0.0) if s == 0.0 else (x - F.lit(m)) / F.lit(s)
                out.append(z.alias(c))
            else:
                out.append(F.col(f"`{c}`"))
        return df.select(*out)


class AlignFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """the fitted feature list in fixed order; a missing feature is 0.0, extra columns are dropped
    (``keepCols`` -- id, label -- are carried along)."""

    features = Param(Params._dummy(), "features", "feature order", typeConverter=TypeConverters.toListString)
    keepCols = Param(Params._dummy(), "keepCols", "columns carried along", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, features: Sequence[str] | None = None, keepCols: Sequence[str] | None = None):
        super().__init__()
        self._setDefault(features=[], keepCols=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = [F.col(f"`{c}`") for c in self.getOrDefault(self.keepCols) if c in df.columns]
        feats = [(F.col(f"`{f}`").cast("double") if f in df.columns else F.lit(0.0)).alias(f)
                 for f in self.getOrDefault(self.features)]
        return df.select(*keep, *feats)
