"""Folds, linear scoring, base models, stacking, cross-validation and batch scoring (M1-M7).

Models are Spark ML estimators; the table-level work around them (folds, out-of-fold predictions,
metrics) is DataFrame code. A fitted model is applied with ``transform``: a narrow, per-row map with
no shuffle, on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import TypeVar

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabrisk.functions import sigmoid, stable_hash
from tabrisk.operators.bins import BINS
from tabrisk.plans.ordering import parts_for, ranked

T = TypeVar("T")


def run_all(spark, tasks: Sequence[Callable[[], T]], threads: int = 4) -> list[T]:
    """Results of independent pieces of driver work, in their order, with at most ``threads`` of them at a time.

    Each runs in a thread that inherits the caller's job properties, so its Spark jobs share the executors with those of the
    others: one fit's small last tasks don't leave the cluster idle. Each has a scheduler pool of its own, which a session with
    ``spark.scheduler.mode=FAIR`` serves in turn. The first error is raised, and what has not started doesn't start.
    """
    from concurrent.futures import ThreadPoolExecutor
    from threading import Event

    from pyspark.util import inheritable_thread_target

    errors: list[BaseException] = []
    failed = Event()

    def pooled(i: int, task: Callable[[], T]) -> T | None:
        if failed.is_set():
            return None
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % max(1, threads)}")
        try:
            return task()
        except BaseException as e:  # noqa: BLE001 - raised again below, in the caller's thread
            errors.append(e)
            failed.set()
            return None

    with ThreadPoolExecutor(max(1, threads)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(pooled), i, t) for i, t in enumerate(tasks)]
        results = [j.result() for j in jobs]
    if errors:
        raise errors[0]
    return results


#: rows that one task of a fit should have: fewer, and starting tasks costs more than their work
ROWS_PER_TASK = 32_768


def spread(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` in partitions of about ``rows`` rows where it has fewer of them than the session has cores, of no more than
    ``ordering.ROWS_PER_PART`` rows on average, and dealt anew where one holds far more than its share.

    A table of few files or row groups would be read by few tasks, whatever its rows (other splits of a file are empty); a small one is
    not worth many.
    """
    now = df.rdd.getNumPartitions()
    n = df.sparkSession.sparkContext.defaultParallelism
    sizes = [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]  # one row per partition
    total = sum(sizes)
    least = parts_for(total)
    want = max(min(n, max(1, -(-total // rows))), least)
    uneven = max(sizes, default=0) > max(rows, 2 * -(-total // want))
    if now >= max(n, least) and not uneven:
        return df
    return df.repartition(want) if want > now or uneven else df.coalesce(want)


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42,
                     fold_col: str = "fold") -> DataFrame:
    """M4: k folds, shuffled by ``md5(id:seed)``, class shares kept (each class dealt round-robin).

    fold = (position of the row inside its class, in hash order) mod k. The position comes from one
    distributed global rank over (label, hash, id) minus the first rank of the class -- a window
    partitioned by the label would put a whole class (half the table) into one task.
    """
    h = stable_hash(id_col, seed)
    r = ranked(df.withColumn("_h", h), [F.col(label).asc_nulls_first(), F.col("_h").asc(), F.col(id_col).asc()],
               "_g")
    starts = r.groupBy(label).agg(F.min("_g").alias("_s"))  # one row per class
    return (r.join(F.broadcast(starts), r[label].eqNullSafe(starts[label]))
            .drop(starts[label])
            .withColumn(fold_col, ((F.col("_g") - F.col("_s")) % k).cast("int"))
            .drop("_g", "_s", "_h"))


def linear_score(weights: Mapping[str, float], intercept: float = 0.0) -> Column:
    """M7: sigma(w.x + b) as a column expression (weights are literals: no join, no UDF)."""
    z = F.lit(float(intercept))
    for c, w in weights.items():
        z = z + F.col(c).cast("double") * F.lit(float(w))
    return sigmoid(z)


def positive_probability(col: str = "probability") -> Column:
    """P(label = 1) from an ML probability vector."""
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------------------------------------
# feature preparation fitted once (F1, F2, F4, F5, F6 + vector)
# ---------------------------------------------------------------------------------------------

def fit_feature_prep(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str],
                     keep: Sequence[str] = (), missing: str = "mean", scale: bool = True, id_col: str = ""):
    """Fit the preparation chain on ``df`` and return a ``PipelineModel`` producing ``features``.

    Stages: NULL category -> 'Unknown'; one-hot (values seen in fit); NULL numbers -> ``missing``: 'knn'
    (five nearest rows, donors ordered by ``id_col``), 'mean' or 'zero';
    population z-score of the numeric columns; fixed feature order (missing -> 0); vector assembly.
    The fitted feature order is ``numeric + one-hot columns`` and is stored in the ``AlignFeatures`` stage.
    """
    from pyspark.ml.feature import VectorAssembler

    from tabrisk.operators.features import AlignFeatures, FillUnknown, MeanFill, OneHot, ZeroFill

    cats, nums = list(categorical), list(numeric)
    stages = []
    cur = df
    if cats:
        fu = FillUnknown(inputCols=cats)
        cur = fu.transform(cur)
        oh = OneHot(inputCols=cats).fit(cur)
        cur = oh.transform(cur)
        stages += [fu, oh]
        dummies = oh.outputCols()
    else:
        dummies = []
    if missing == "knn" and nums:
        from tabrisk.operators.features import PopulationScaler
        from tabrisk.operators.knn import KnnImputer
        fill = KnnImputer(inputCols=nums, idCol=id_col).fit(cur)
        stages.append(fill)
        if scale:
            stages.append(PopulationScaler(inputCols=nums).fit(fill.transform(cur)))
    elif scale and nums:
        # fill values and post-fill population statistics from one aggregation over the raw columns
        fill, sc = _fill_and_scale(cur, nums, missing)
        stages += [fill, sc]
    else:
        fill = ZeroFill(inputCols=nums) if missing == "zero" else MeanFill(inputCols=nums).fit(cur)
        stages.append(fill)
    feats = nums + dummies
    # ``_keep`` carries caller columns (ids, labels, folds) through scoring untouched
    stages.append(AlignFeatures(features=feats, keepCols=list(keep) + ["_keep"]))
    stages.append(VectorAssembler(inputCols=feats, outputCol="features", handleInvalid="keep"))
    return PipelineModel(stages)


def _fill_and_scale(df: DataFrame, nums: Sequence[str], missing: str):
    """Fitted fill stage + population scaler of the filled columns, in one pass.

    Mean fill leaves the mean unchanged and adds zero deviations: the filled population variance is
    the variance of the present values times (present / all). Zero fill is aggregated on the filled values.
    """
    from tabrisk.operators.features import FillModel, ScalerModel, ZeroFill
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(nums):
        x = F.col(c).cast("double")
        if missing == "zero":
            x = F.coalesce(x, F.lit(0.0))
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.count(x).alias(f"k{i}")]
    r = df.agg(*aggs).first()
    n = r["_n"] or 0
    means, stds = [], []
    for i in range(len(nums)):
        m, s, k = float(r[f"m{i}"] or 0.0), float(r[f"s{i}"] or 0.0), r[f"k{i}"] or 0
        means.append(m)
        stds.append(s * (k / n) ** 0.5 if n else 0.0)
    fill = ZeroFill(inputCols=list(nums)) if missing == "zero" else FillModel(inputCols=list(nums), values=means)
    return fill, ScalerModel(inputCols=list(nums), means=means, stds=stds)


def feature_list(prep) -> list[str]:
    from tabrisk.operators.features import AlignFeatures
    for s in prep.stages:
        if isinstance(s, AlignFeatures):
            return list(s.getOrDefault(s.features))
    return []


# ---------------------------------------------------------------------------------------------
# M1, M2: base learners
# ---------------------------------------------------------------------------------------------

# more memory for histograms means fewer passes per level
TREE_JOBS = dict(maxMemoryInMB=1024)


def forest(num_trees: int = 200, max_depth: int = 30, min_leaf: int = 2, seed: int = 42, name: str = "rf",
           label: str = "label"):
    """M1: random forest without bootstrap, sqrt features per split, leaves of >= 2 rows.

    The original grows trees without a depth limit; Spark caps depth at 30. In a forest of this size rows with equal bins and
    label are fitted as one weighted row (``operators.bins``), with the same trees.
    """
    from tabrisk.operators.bins import BinnedForestClassifier
    return BinnedForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, bootstrap=False,
                                  featureSubsetStrategy="sqrt", minInstancesPerNode=min_leaf,
                                  maxDepth=min(max_depth, 30), seed=seed, probabilityCol=f"prob_{name}",
                                  rawPredictionCol=f"raw_{name}", predictionCol=f"pred_{name}",
                                  cacheNodeIds=True, **TREE_JOBS)  # deep trees, many at once: they aren't sent with every level


def boost(rounds: int = 200, rate: float = 0.05, max_depth: int = 5, subsample: float = 0.8, seed: int = 42,
          name: str = "gbt", label: str = "label"):
    """M2: gradient-boosted trees (Spark's level-wise GBT; no L1/L2 leaf penalties exist in it), grown from histograms of binned rows
    (``operators.trees``), with the same trees."""
    from tabrisk.operators.trees import BoostClassifier
    est = BoostClassifier(featuresCol="features", labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=max_depth,
                          subsamplingRate=subsample, seed=seed, predictionCol=f"pred_{name}", **TREE_JOBS)
    return est.setProbabilityCol(f"prob_{name}").setRawPredictionCol(f"raw_{name}")


def _trees(model):
    """The model that gives the probabilities: the last stage where bins come first."""
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def _prob_col(est) -> str:
    est = _trees(est)
    return est.getOrDefault(est.probabilityCol)


def _extra_cols(model) -> list[str]:
    """Columns that applying a base model adds."""
    m = _trees(model)
    return [_prob_col(m), m.getOrDefault(m.rawPredictionCol), m.getOrDefault(m.predictionCol), BINS]


def _scored(model, df: DataFrame, name: str) -> DataFrame:
    """``df`` with P(label = 1) by a base model as the column ``name`` and nothing else new."""
    from tabrisk.operators.bins import BinFeatures, scored_by_cell
    score = _positive(_prob_col(model))
    if isinstance(model, PipelineModel) and isinstance(model.stages[0], BinFeatures):
        return scored_by_cell(model, df, score, name)
    return model.transform(df).withColumn(name, score).drop(*_extra_cols(model))


def _positive(col: str) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(F.col(col))[1]


# ---------------------------------------------------------------------------------------------
# M3: stacking
# ---------------------------------------------------------------------------------------------

class StackingModel:
    """Fitted stack: base models refitted on all rows + a logistic meta model on their probabilities."""

    def __init__(self, bases: list, names: list[str], meta, label: str = "label"):
        self.bases, self.names, self.meta, self.label = bases, names, meta, label

    def base_scores(self, df: DataFrame) -> DataFrame:
        out = df
        for m, n in zip(self.bases, self.names):
            out = _scored(m, out, f"p_{n}")
        return out

    def transform(self, df: DataFrame, score_col: str = "score") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        s = self.base_scores(df)
        s = VectorAssembler(inputCols=[f"p_{n}" for n in self.names], outputCol="_meta").transform(s)
        s = self.meta.transform(s).withColumn(score_col, _positive("_meta_prob"))
        return s.drop("_meta", "_meta_prob", "_meta_raw", "_meta_pred")

    def save(self, path: str) -> None:
        import json
        for m, n in zip(self.bases, self.names):
            m.write().overwrite().save(f"{path}/base_{n}")
        self.meta.write().overwrite().save(f"{path}/meta")
        from pyspark.sql import SparkSession
        ss = SparkSession.getActiveSession()
        kinds = [type(m).__name__ for m in self.bases]
        ss.createDataFrame([(json.dumps({"names": self.names, "kinds": kinds, "label": self.label}),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/layout")

    @staticmethod
    def load(path: str) -> "StackingModel":
        import json

        from pyspark.ml import classification as C
        from pyspark.sql import SparkSession
        ss = SparkSession.getActiveSession()
        layout = json.loads(ss.read.text(f"{path}/layout").first()[0])
        bases = [getattr(C, k, PipelineModel).load(f"{path}/base_{n}") for k, n in zip(layout["kinds"], layout["names"])]
        meta = C.LogisticRegressionModel.load(f"{path}/meta")
        return StackingModel(bases, layout["names"], meta, layout["label"])


class StackingClassifier:
    """M3 (Wolpert 1992): out-of-fold base probabilities -> logistic regression; bases refitted on all rows.

    Folds are stratified (M4) on ``id_col`` over one table, fold-tagged, evenly partitioned and kept for all fits. The fits of
    the folds and those on all rows don't need each other and run ``threads`` at a time.
    """

    def __init__(self, bases: Sequence, id_col: str, label: str = "label", inner_folds: int = 5, seed: int = 42, threads: int = 4):
        self.bases, self.id_col, self.label, self.k, self.seed = list(bases), id_col, label, inner_folds, seed
        self.threads = threads

    def fit(self, df: DataFrame) -> StackingModel:
        from pyspark import StorageLevel
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        names = [_prob_col(b).replace("prob_", "") for b in self.bases]
        tagged = stratified_folds(df.select(self.id_col, self.label, "features"), self.id_col, self.label, self.k, self.seed, "_ifold")
        folds = spread(tagged).persist(StorageLevel.MEMORY_AND_DISK)
        folds.count()  # once, before the fits ask for it at the same time
        tasks = [lambda b=b, f=f: b.fit(folds.filter(F.col("_ifold") != f)) for f in range(self.k) for b in self.bases]
        tasks += [lambda b=b: b.fit(folds) for b in self.bases]
        models = run_all(df.sparkSession, tasks, self.threads)

        def held_out(f: int) -> DataFrame:
            part = folds.filter(F.col("_ifold") == f)
            for m, n in zip(models[f * len(names):], names):
                part = _scored(m, part, f"p_{n}")
            return part.select(self.label, *[f"p_{n}" for n in names])

        oof = run_all(df.sparkSession, [lambda f=f: held_out(f) for f in range(self.k)], self.threads)
        meta_train = oof[0]
        for o in oof[1:]:
            meta_train = meta_train.unionByName(o)
        meta_train = VectorAssembler(inputCols=[f"p_{n}" for n in names], outputCol="_meta").transform(meta_train)
        # the fit reads its input many times; without the cut every pass would score the out-of-fold rows again
        meta_train = meta_train.select(self.label, "_meta").persist(StorageLevel.MEMORY_AND_DISK)
        meta = LogisticRegression(featuresCol="_meta", labelCol=self.label, probabilityCol="_meta_prob",
                                  rawPredictionCol="_meta_raw", predictionCol="_meta_pred").fit(meta_train)
        meta_train.unpersist()
        folds.unpersist()
        return StackingModel(models[self.k * len(names):], names, meta, self.label)


# ---------------------------------------------------------------------------------------------
# M5, M6: cross-validation and batch scoring
# ---------------------------------------------------------------------------------------------

class Validated(tuple):
    """(per-fold metrics, summary); ``final`` is the scorer refitted on all rows."""

    final: Callable[[DataFrame], DataFrame] | None = None


def cross_validate(df: DataFrame, make_model, id_col: str, label: str = "label", k: int = 5, seed: int = 42, threads: int = 2) -> Validated:
    """M5: outer stratified folds; per fold fit on the others (``make_model(train) -> scorer``) and score the
    fold, then refit on all rows; returns (per-fold metrics, summary). Folds and the refit are independent sets of Spark jobs, ``threads`` at a time."""
    from pyspark import StorageLevel

    from tabrisk.operators.metrics import cv_summary, fold_metrics
    folds = spread(stratified_folds(df, id_col, label, k, seed, "fold")).persist(StorageLevel.MEMORY_AND_DISK)
    folds.count()

    def one(f: int) -> DataFrame:
        scorer = make_model(folds.filter(F.col("fold") != f))
        s = scorer(folds.filter(F.col("fold") == f)).select("fold", F.col(label).alias("label"), "score")
        return s.checkpoint(eager=True)

    *scored, final = run_all(df.sparkSession, [*(lambda f=f: one(f) for f in range(k)), lambda: make_model(folds)], threads)
    allp = scored[0]
    for s in scored[1:]:
        allp = allp.unionByName(s)
    per = fold_metrics(allp)
    folds.unpersist()
    out = Validated((per, cv_summary(per)))
    out.final = final
    return out


def score_batch(prep, model, df: DataFrame, keep: Sequence[str] = (), score_col: str = "score") -> DataFrame:
    """M6: P(label = 1) per record: fitted preparation + fitted model, a narrow map (batch or stream)."""
    x = prep.transform(df.withColumn("_keep", F.struct(*[F.col(c) for c in keep])) if keep else df)
    if isinstance(model, StackingModel):
        out = model.transform(x, score_col)
    else:
        out = _scored(model, x, score_col)
    return out.select("_keep.*", score_col) if keep else out.select(score_col)
