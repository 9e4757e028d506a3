"""Incremental (online) learning on newly arrived records.

State lives in one append-only Parquet log under a shared folder: one row per trained batch with the
weights, intercept, last trained id, metrics and the Structured Streaming batch id. Appending that
row is the commit point, so a batch is either fully recorded or not at all; replaying a micro-batch
whose id is already in the log changes nothing (``foreachBatch`` is at-least-once). The fitted
feature preparation is saved once, beside the log, on the first batch and reused afterwards.

Two update rules (M8):
* ``gradient`` (default): full-batch gradient steps of the log loss, one aggregation job per step
  (deterministic; checked against SQL);
* ``sgd`` (nearest to the original's per-row SGD): every partition makes one sequential pass
  over its rows starting from the stored weights (vectorised per Arrow batch in ``mapInPandas``), and
  the partition results are averaged weighted by row count (Zinkevich et al. 2010). Only one small
  row per partition reaches the driver.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.functions import sigmoid
from tabrisk.operators.query import oldest_n, sample_n, watermark_filter

LOG_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("stream_batch", T.LongType()),
    T.StructField("timestamp", T.StringType()), T.StructField("samples_trained", T.LongType()),
    T.StructField("id_range", T.StringType()), T.StructField("last_trained_id", T.LongType()),
    T.StructField("metrics", T.StructType([T.StructField("auc_score", T.DoubleType()),
                                           T.StructField("accuracy", T.DoubleType())])),
    T.StructField("auc_before", T.DoubleType()), T.StructField("status", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()),
])


@dataclass
class OnlineConfig:
    id_col: str
    label_col: str
    numeric: Sequence[str]
    categorical: Sequence[str] = ()
    rule: str = "gradient"     # 'gradient' | 'sgd'
    eta0: float = 0.01
    alpha: float = 1e-4        # L2 penalty of the per-row rule
    steps: int = 1             # gradient steps per batch for rule='gradient'


class OnlineStore:
    """The training log (create if missing; damaged files are set aside, the rows of the others count) and the saved prep."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def log(self) -> DataFrame:
        from tabrisk.sources.tables import path_exists
        if not path_exists(self.spark, f"{self.root}/log"):
            return self.spark.createDataFrame([], LOG_SCHEMA)
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException
        log = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")
        try:
            log.count()  # the log has one row per batch; the read is lazy, so look at it here
        except (PySparkException, Py4JJavaError):
            if not self._set_damaged_aside():
                raise  # every file is sound: the storage failed, and the log is as it was
            log = self.spark.read.schema(LOG_SCHEMA).parquet(f"{self.root}/log")
        return log

    def _set_damaged_aside(self) -> int:
        """Move files of the log that can't be decoded to ``log_damaged``; the rows of the others stay. Returns their number.

        A file counts as damaged only if all its bytes can be read and Spark still can't make rows of them: where the storage
        itself fails, the error goes to the caller and nothing is moved.
        """
        from py4j.protocol import Py4JJavaError
        from pyspark.errors import PySparkException
        jvm = self.spark.sparkContext._jvm
        folder, aside = (jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}") for x in ("log", "log_damaged"))
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        moved = 0
        for status in fs.listStatus(folder):
            path = status.getPath()
            if path.getName()[0] in "_.":
                continue
            try:
                self.spark.read.schema(LOG_SCHEMA).parquet(path.toString()).collect()  # one row
            except (PySparkException, Py4JJavaError):
                stream = fs.open(path)
                try:
                    size = jvm.org.apache.commons.io.IOUtils.consume(stream)
                finally:
                    stream.close()
                if size != status.getLen():
                    raise
                fs.mkdirs(aside)
                moved += fs.rename(path, jvm.org.apache.hadoop.fs.Path(aside, path.getName()))
        return moved

    def latest(self):
        return self.log().filter(F.col("status") == "trained").orderBy(F.col("batch_id").desc()).limit(1).first()

    def has_stream_batch(self, stream_batch: int) -> bool:
        return not self.log().filter(F.col("stream_batch") == stream_batch).isEmpty()

    def append(self, row: tuple) -> DataFrame:
        df = self.spark.createDataFrame([row], LOG_SCHEMA)
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/log")
        return df

    def prep(self):
        from pyspark.ml import PipelineModel

        from tabrisk.sources.tables import path_exists
        if not path_exists(self.spark, f"{self.root}/prep/metadata"):
            return None
        return PipelineModel.load(f"{self.root}/prep")

    def save_prep(self, prep) -> None:
        prep.write().overwrite().save(f"{self.root}/prep")


def history_view(log: DataFrame) -> DataFrame:
    """Timestamp, samples, id range, AUC and accuracy to 4 decimals, in batch order."""
    return log.filter(F.col("status") == "trained").select(
        "batch_id", "timestamp", "samples_trained", "id_range",
        F.round("metrics.auc_score", 4).alias("auc_score"), F.round("metrics.accuracy", 4).alias("accuracy"))


def linear_logit(features: Sequence[str], weights: Sequence[float], intercept: float):
    z = F.lit(float(intercept))
    for f, w in zip(features, weights):
        z = z + F.col(f"`{f}`") * F.lit(float(w))
    return z


def gradient_steps(x: DataFrame, features: Sequence[str], label: str, weights: Sequence[float],
                   intercept: float, lr: float, steps: int) -> tuple[list[float], float]:
    """``steps`` full-batch gradient steps of the mean log loss; one aggregation job per step."""
    w, b = [float(v) for v in weights], float(intercept)
    for _ in range(steps):
        err = sigmoid(linear_logit(features, w, b)) - F.col(label).cast("double")
        r = x.agg(*[F.avg(err * F.col(f"`{f}`")).alias(f"g{i}") for i, f in enumerate(features)],
                  F.avg(err).alias("gb")).first()
        w = [wi - lr * (r[f"g{i}"] or 0.0) for i, wi in enumerate(w)]
        b = b - lr * (r["gb"] or 0.0)
    return w, b


def partition_sgd(x: DataFrame, features: Sequence[str], label: str, weights: Sequence[float], intercept: float,
                  eta0: float, alpha: float) -> tuple[list[float], float]:
    """One sequential log-loss SGD pass per partition, then the row-count-weighted average."""
    feats = list(features)
    w0, b0 = [float(v) for v in weights], float(intercept)
    out_schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("b", T.DoubleType())]
                              + [T.StructField(f"w{i}", T.DoubleType()) for i in range(len(feats))])

    def run(batches):
        import numpy as np
        import pandas as pd
        w, b, n = np.array(w0, dtype="float64"), b0, 0
        for pdf in batches:
            xs = pdf[feats].to_numpy(dtype="float64", na_value=0.0)
            ys = pdf[label].to_numpy(dtype="float64")
            for i in range(len(ys)):  # the update of row i depends on row i-1: sequential by nature
                z = float(xs[i] @ w) + b
                p = 1.0 / (1.0 + np.exp(-z)) if z > -700 else 0.0
                g = p - ys[i]
                w = w - eta0 * (g * xs[i] + alpha * w)
                b = b - eta0 * g
            n += len(ys)
        if n:
            yield pd.DataFrame([[n, b] + list(w)], columns=["n", "b"] + [f"w{i}" for i in range(len(feats))])

    parts = x.select(*[F.col(f"`{f}`").cast("double").alias(f) for f in feats], F.col(label).cast("double")) \
        .mapInPandas(run, out_schema)
    r = parts.agg(F.sum("n").alias("n"), (F.sum(F.col("b") * F.col("n")) / F.sum("n")).alias("b"),
                  *[(F.sum(F.col(f"w{i}") * F.col("n")) / F.sum("n")).alias(f"w{i}") for i in range(len(feats))]
                  ).first()
    if not r["n"]:
        return w0, b0
    return [float(r[f"w{i}"]) for i in range(len(feats))], float(r["b"])


def _batch_metrics(x: DataFrame, label: str, score, with_accuracy: bool = True) -> tuple[float | None, float | None]:
    from tabrisk.operators.metrics import accuracy, auc
    s = x.select(F.col(label).cast("int").alias("label"), score.alias("score")).cache()
    a = auc(s).first()["auc"]
    acc = accuracy(s).first()["accuracy"] if with_accuracy else None
    s.unpersist()
    return a, acc


def train_batch(spark: SparkSession, batch: DataFrame, cfg: OnlineConfig, store: OnlineStore,
                prev, stream_batch: int | None = None) -> DataFrame:
    """Train on one batch of new rows and append its log row; returns the log row (status row if empty).

    ``prev`` is the latest trained log row (``store.latest()``, read once by the caller) or None.
    """
    from tabrisk.operators.models import feature_list, fit_feature_prep
    now = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    mark = int(prev["last_trained_id"]) if prev is not None else None
    batch = batch.cache()
    stats = batch.agg(F.count("*").alias("n"), F.max(cfg.id_col).alias("hi"), F.min(cfg.id_col).alias("lo")).first()
    if not stats["n"]:
        batch.unpersist()
        empty = (None, stream_batch, now, 0, None, mark, None, None, "no_data", None, None, None)
        # a micro-batch leaves its row even when it is empty, as its replay is told by that row
        return store.append(empty) if stream_batch is not None else spark.createDataFrame([empty], LOG_SCHEMA)
    prep = store.prep()
    if prep is None:  # fitted once, on the first batch, then reused (the original refits every call)
        prep = fit_feature_prep(batch, cfg.categorical, cfg.numeric, keep=[cfg.label_col])
        store.save_prep(prep)
    feats = feature_list(prep)
    x = prep.transform(batch).drop("features").cache()
    if prev is not None and list(prev["features"] or []) == feats:
        w, b = list(prev["weights"]), float(prev["intercept"])
    else:
        w, b = [0.0] * len(feats), 0.0
    before = (_batch_metrics(x, cfg.label_col, sigmoid(linear_logit(feats, w, b)), with_accuracy=False)[0]
              if prev is not None else None)
    if cfg.rule == "gradient":
        w, b = gradient_steps(x, feats, cfg.label_col, w, b, cfg.eta0, cfg.steps)
    else:
        w, b = partition_sgd(x, feats, cfg.label_col, w, b, cfg.eta0, cfg.alpha)
    a, acc = _batch_metrics(x, cfg.label_col, sigmoid(linear_logit(feats, w, b)))
    x.unpersist()
    batch.unpersist()
    # a streamed batch may hold ids at or below the mark; the mark never goes back
    hi = int(stats["hi"]) if mark is None else max(mark, int(stats["hi"]))
    lo = int(stats["lo"]) if stream_batch is not None else (mark or 0) + 1
    bid = (int(prev["batch_id"]) + 1) if prev is not None else 0
    id_range = f"{lo}-{stats['hi']}"
    row = (bid, stream_batch, now, int(stats["n"]), id_range, hi, (a, acc), before, "trained",
           feats, [float(v) for v in w], float(b))
    return store.append(row)


def incremental_batch(spark: SparkSession, table: DataFrame, cfg: OnlineConfig, store: OnlineStore,
                      n: int | None = None, take: str = "oldest", seed: int = 42) -> DataFrame:
    """M9 batch mode: rows above the stored mark (P5), optionally n of them, trained as one batch.

    ``take='oldest'`` trains the n smallest new ids, found by selection on the id column, so no id is skipped; ``take='random'`` draws n rows
    by seeded hash as the original does (then unsampled smaller ids fall below the new mark).
    """
    if n is not None and (not isinstance(n, int) or n <= 0):
        raise ValueError("n must be a positive integer")
    prev = store.latest()
    mark = int(prev["last_trained_id"]) if prev is not None else None
    new = watermark_filter(table, cfg.id_col, mark) if mark is not None else table
    if n is not None:
        if take == "random":
            new = sample_n(new, cfg.id_col, n, seed)
        else:
            new = oldest_n(new, cfg.id_col, n)
    return train_batch(spark, new, cfg, store, prev)


def run_stream(spark: SparkSession, source_path: str, schema: T.StructType, cfg: OnlineConfig, store: OnlineStore,
               checkpoint: str, max_files_per_trigger: int = 1, fmt: str = "parquet", derive=None) -> DataFrame:
    """M9 stream mode: every micro-batch of new files is one training batch (``availableNow``).

    A streaming source delivers every row once and its checkpoint marks the progress, so each micro-batch is
    trained whole, whatever ids it holds (its size is set by ``maxFilesPerTrigger``). The stored mark is for batch
    mode: the highest id trained so far.
    """

    def step(bdf: DataFrame, stream_batch: int) -> None:
        if store.has_stream_batch(stream_batch):
            return  # replay of a batch already recorded
        if derive is not None:
            bdf = derive(bdf)
        train_batch(bdf.sparkSession, bdf, cfg, store, store.latest(), stream_batch)

    q = (spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
         .load(source_path)
         .writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return history_view(store.log())


def score_incremental(df: DataFrame, store: OnlineStore, keep: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Score rows with the incrementally trained model: stored preparation and the latest stored weights.

    Returns the kept columns, ``score`` (probability of the positive class) and ``pred``. One narrow map per row.
    """
    prev, prep = store.latest(), store.prep()
    if prev is None or prep is None:
        raise ValueError("nothing has been trained yet")
    x = prep.transform(df)
    p = sigmoid(linear_logit(list(prev["features"]), list(prev["weights"]), float(prev["intercept"])))
    return x.select(*keep, p.alias("score"), (p > F.lit(threshold)).cast("int").alias("pred"))
