"""Evaluation metrics as relational aggregates.

Inputs are a DataFrame with a 0/1 ``label`` column and a probability ``score`` column. Everything is
an aggregation with map-side partial aggregation; the ROC curve and the exact AUC need running sums
over distinct scores, done with the distributed two-pass method of ``plans.ordering.cumulative``
(range partitions + partition offsets) instead of a single-task window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.functions import clip_prob
from tabrisk.operators.query import threshold_label
from tabrisk.plans.ordering import cumulative

EPS = 1e-15


def counts(df: DataFrame, label: str = "label") -> DataFrame:
    """A1: rows, positives, negatives, columns."""
    return df.agg(F.count("*").alias("n_rows"),
                  F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("n_pos"),
                  F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).cast("long").alias("n_neg"),
                  F.lit(len(df.columns)).alias("n_cols"))


def accuracy(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """A2: share of rows whose thresholded score equals the label."""
    pred = threshold_label(score, threshold)
    return df.agg(F.avg((pred == F.col(label)).cast("double")).alias("accuracy"))


def log_loss(df: DataFrame, label: str = "label", score: str = "score", eps: float = EPS) -> DataFrame:
    """A3: mean negative log-likelihood with probabilities clipped to [eps, 1 - eps]."""
    p = clip_prob(score, eps)
    ll = F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p))
    return df.agg((-F.avg(ll)).alias("log_loss"))


def score_counts(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, pos, neg) per distinct score: partial aggregation, one row per distinct score."""
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("neg"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", bins: int | None = None) -> DataFrame:
    """A4: (threshold, fpr, tpr) per distinct score, thresholds descending (a score >= threshold is positive).

    ``bins``: thin the curve to at most ``bins + 1`` points, keeping in every fpr bucket the point with the
    highest fpr (then tpr) -- for drawing; the AUC is always computed from the full curve."""
    full = _roc_full(df, label, score)
    if not bins:
        return full
    b = F.floor(F.col("fpr") * F.lit(bins))
    return (full.groupBy(b.alias("_b"))
            .agg(F.max_by(F.struct("threshold", "fpr", "tpr"), F.struct("fpr", "tpr")).alias("p"))
            .select("p.threshold", "p.fpr", "p.tpr"))


def _roc_full(df: DataFrame, label: str, score: str) -> DataFrame:
    sc = score_counts(df, label, score)
    cum = cumulative(sc, [F.col("threshold").desc()], ["pos", "neg"])
    # class totals = the last running sums (read from the materialised running sums, one small job)
    tot = cum.agg(F.max("pos_cum").alias("P"), F.max("neg_cum").alias("N")).first()
    p_tot, n_tot = tot["P"] or 0.0, tot["N"] or 0.0
    return cum.select(
        "threshold",
        (F.col("neg_cum") / F.lit(n_tot) if n_tot else F.lit(None).cast("double")).alias("fpr"),
        (F.col("pos_cum") / F.lit(p_tot) if p_tot else F.lit(None).cast("double")).alias("tpr"))


def auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """A5: exact area under the ROC curve (trapezoids; a tie counts one half). NULL for one class."""
    sc = score_counts(df, label, score)
    cum = cumulative(sc, [F.col("threshold").desc()], ["pos"])
    # positives strictly above each threshold = running sum minus this threshold's positives
    part = cum.select((F.col("neg") * (F.col("pos_cum") - F.col("pos") + F.col("pos") / 2.0)).alias("a"),
                      "pos", "neg")
    agg = part.agg(F.sum("a").alias("a"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("a") / (F.col("P") * F.col("N")))
                      .alias("auc"))


def confusion_matrix(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Counts per (actual, predicted)."""
    pred = threshold_label(score, threshold)
    return (df.select(F.col(label).cast("int").alias("actual"), pred.alias("predicted"))
            .groupBy("actual").pivot("predicted", [0, 1]).count()
            .select("actual", F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("pred_0"),
                    F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("pred_1")))


def class_report(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages.

    One aggregation job yields the four confusion counts; the five report rows are arithmetic on them.
    """
    pred = threshold_label(score, threshold)
    y = F.col(label).cast("int")
    g = df.agg(*[F.sum(F.when((y == a) & (pred == b), 1).otherwise(0)).cast("double").alias(f"c{a}{b}")
                 for a in (0, 1) for b in (0, 1)]).first()
    c = {k: (g[k] or 0.0) for k in ("c00", "c01", "c10", "c11")}
    rows = []
    for k in (0, 1):
        o = 1 - k
        tp, fp, fn = c[f"c{k}{k}"], c[f"c{o}{k}"], c[f"c{k}{o}"]
        prec = tp / (tp + fp) if tp + fp > 0 else 0.0
        rec = tp / (tp + fn) if tp + fn > 0 else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec > 0 else 0.0
        rows.append((str(k), prec, rec, f1, tp + fn))
    n = sum(r[4] for r in rows)
    acc = (c["c00"] + c["c11"]) / n if n else None
    rows.append(("accuracy", acc, acc, acc, n))
    rows.append(("macro avg", *[sum(r[i] for r in rows[:2]) / 2 for i in (1, 2, 3)], n))
    rows.append(("weighted avg", *[(sum(r[i] * r[4] for r in rows[:2]) / n if n else None) for i in (1, 2, 3)], n))
    return df.sparkSession.createDataFrame(
        rows, "class string, precision double, recall double, f1 double, support double")


def fold_metrics(df: DataFrame, fold: str = "fold", label: str = "label", score: str = "score",
                 eps: float = EPS) -> DataFrame:
    """Per fold: accuracy, log loss and exact AUC (AUC from per-(fold, score) counts and running sums)."""
    pred = threshold_label(score, 0.5)
    p = clip_prob(score, eps)
    base = df.groupBy(fold).agg(
        F.avg((pred == F.col(label)).cast("double")).alias("accuracy"),
        (-F.avg(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(F.lit(1.0) - p)))).alias("log_loss"))
    sc = df.groupBy(fold, F.col(score).alias("threshold")).agg(
        F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("pos"),
        F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("neg"))
    # running sums per fold: order by (fold, threshold desc); subtract the fold's starting offset
    cum = cumulative(sc, [F.col(fold).asc(), F.col("threshold").desc()], ["pos"])
    start = cum.groupBy(fold).agg((F.min(F.col("pos_cum") - F.col("pos"))).alias("_start"))
    part = cum.join(F.broadcast(start), fold).select(
        fold, (F.col("neg") * (F.col("pos_cum") - F.col("_start") - F.col("pos") + F.col("pos") / 2.0)).alias("a"),
        "pos", "neg")
    a = part.groupBy(fold).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum("a") / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return base.join(a, fold)


def cv_summary(per_fold: DataFrame, metrics=("accuracy", "log_loss", "auc")) -> DataFrame:
    """Mean and population std of each metric over the folds (one row per metric)."""
    long = per_fold.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double")
                                                         .alias("value")) for m in metrics])).alias("e"))
    return long.groupBy(F.col("e.metric").alias("metric")).agg(
        F.avg("e.value").alias("mean"), F.stddev_pop("e.value").alias("std"))


def case_report(df: DataFrame, prep, model, id_col: str, label: str = "label", n: int = 2,
                seed: int = 42) -> DataFrame:
    """N rows per class and n rows of any class (hash-ordered exact samples), scored; per row the
    probability, predicted class, correct flag; per group the accuracy (window over the <= 3n rows)."""
    from pyspark.sql import Window

    from tabrisk.operators.models import score_batch
    from tabrisk.operators.query import sample_n, sample_per_class

    per_class = sample_per_class(df, id_col, label, n, seed).withColumn(
        "grp", F.when(F.col(label) == 1, F.lit("positive")).otherwise(F.lit("negative")))
    anyc = sample_n(df, id_col, n, seed + 1).withColumn("grp", F.lit("random"))
    cases = per_class.unionByName(anyc)
    scored = score_batch(prep, model, cases, keep=[id_col, label, "grp"])
    pred = threshold_label("score")
    out = scored.select("grp", id_col, F.col(label).alias("actual"), F.col("score").alias("probability"),
                        pred.alias("predicted"), (pred == F.col(label)).cast("int").alias("correct"))
    return out.withColumn("group_accuracy", F.avg("correct").over(Window.partitionBy("grp")))
