"""Classification metrics (A-25, A-27, A-29, M-01..M-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.beside import beside
from tessera.functions.rank import avg_rank, cumulative
from tessera.session import materialize


def confusion(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """``(label, prediction, count)`` over the full label x label grid (zeros kept).

    Counts come from one partial-aggregated ``groupBy``.  The grid has labels
    squared rows by definition; labels meet blocks of labels by an equi-join.
    """
    counts = df.groupBy(F.col(y).alias("label"), F.col(pred).alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("count"))
    labels = df.select(F.col(y).alias("l")).union(df.select(F.col(pred).alias("l"))).distinct()
    labels = materialize(labels.where(F.col("l").isNotNull()), "labels")
    grid = beside(labels.withColumnRenamed("l", "label"), labels, "l", F.col("label"), "_all") \
        .select("label", F.explode("_all.l").alias("prediction"))
    return grid.join(counts, ["label", "prediction"], "left") \
        .select("label", "prediction", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _cells(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Rows per (label, prediction).  Written once: the rows of ``df`` are
    often a whole model's work, and every figure follows from these counts."""
    return materialize(df.groupBy(F.col(y).alias("label"), F.col(pred).alias("prediction"))
                       .agg(F.count(F.lit(1)).alias("n")), "cells")


def _accuracy() -> Column:
    """Share of right rows, from the counts; rows without a label or prediction are left out."""
    right = F.col("label") == F.col("prediction")
    return F.try_divide(F.sum(F.when(right, F.col("n")).when(~right, F.lit(0))), F.sum(F.when(right.isNotNull(), F.col("n"))))


def _per_class(cm: DataFrame) -> DataFrame:
    """Per class: tp, fp, fn, support."""
    as_true = cm.groupBy("label").agg(F.sum("n").alias("support"),
                                      F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n"))
                                            .otherwise(0)).alias("tp"))
    as_pred = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    j = as_true.join(as_pred, "label", "full")
    return j.select("label", F.coalesce("support", F.lit(0)).alias("support"),
                    F.coalesce("tp", F.lit(0)).alias("tp"),
                    F.coalesce("predicted", F.lit(0)).alias("predicted"))


def _prf(pc: DataFrame) -> DataFrame:
    p = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return pc.select("label", "support", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def classification_metrics(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """accuracy, precision, recall, f1 — positive class (the larger label)
    when there are two classes, support-weighted means otherwise; zero
    division gives 0."""
    cm = _cells(df, y, pred)
    pc = _prf(_per_class(cm))
    stats = pc.agg(F.count(F.when(F.col("support") > 0, 1)).alias("k"),
                   F.max(F.when(F.col("support") > 0, F.col("label"))).alias("pos"),
                   F.sum("support").alias("n")).first()
    acc = cm.agg(_accuracy().alias("accuracy"))
    labels_all = pc.agg(F.count(F.lit(1)).alias("k_all"), F.max("label").alias("pos_all")).first()
    if labels_all["k_all"] <= 2:
        pos = labels_all["pos_all"]
        m = pc.where(F.col("label") == F.lit(pos)).select("precision", "recall", "f1")
    else:
        w = F.col("support") / F.lit(float(stats["n"]))
        m = pc.agg((F.sum(F.col("precision") * w)).alias("precision"),
                   (F.sum(F.col("recall") * w)).alias("recall"), (F.sum(F.col("f1") * w)).alias("f1"))
    a = acc.first()["accuracy"]
    return m.select(F.lit(a).alias("accuracy"), "precision", "recall", "f1")


def classification_report(df: DataFrame, y: str = "label", pred: str = "prediction") -> DataFrame:
    """Per-class precision / recall / f1 / support, then accuracy, macro avg
    and weighted avg rows (``class`` is text)."""
    cm = _cells(df, y, pred)
    pc = _prf(_per_class(cm))
    per = pc.select(F.col("label").cast("string").alias("class"), "precision", "recall", "f1",
                    F.col("support").cast("bigint").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                   F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                   F.sum("support").cast("bigint").alias("support"))
    weighted = pc.agg(F.lit("weighted avg").alias("class"),
                      (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                      (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                      (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                      F.sum("support").cast("bigint").alias("support"))
    acc = cm.agg(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), _accuracy().alias("f1"),
                 F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def class_counts(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy(y).agg(F.count(F.lit(1)).alias("count"))


def roc_curve(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    """``(threshold, fpr, tpr)``: one point per distinct score (descending),
    plus the origin with threshold +inf.  Running totals per range
    (:func:`cumulative`), no single-partition window."""
    pos = (F.col(y) == F.lit(positive)).cast("long")
    base = df.select(F.col(score).cast("double").alias("threshold"), pos.alias("tp"),
                     (1 - pos).alias("fp"))
    tot = base.agg(F.sum("tp").alias("P"), F.sum("fp").alias("N")).first()
    c = cumulative(base, "threshold", ["tp", "fp"], desc=True)
    P, N = float(tot["P"] or 0), float(tot["N"] or 0)
    pts = c.select("threshold", (F.try_divide(F.col("cum_fp"), F.lit(N))).alias("fpr"),
                   (F.try_divide(F.col("cum_tp"), F.lit(P))).alias("tpr"))
    origin = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return origin.unionByName(pts)


def auc(df: DataFrame, y: str, score: str, positive=1) -> float | None:
    """Area under the ROC curve (trapezoids over all points) computed as the
    Mann-Whitney statistic with average ranks — identical value, and the
    ranking is distributed."""
    d = df.select(F.col(score).cast("double").alias("value"),
                  (F.col(y) == F.lit(positive)).cast("long").alias("_pos"))
    ranks = avg_rank(d, [], "value")
    pos_by_value = d.groupBy("value").agg(F.sum("_pos").alias("_p"), F.count(F.lit(1)).alias("_n"))
    j = ranks.join(pos_by_value, "value")
    r = j.agg(F.sum(F.col("_p") * F.col("rank")).alias("rs"), F.sum("_p").alias("P"),
              F.sum(F.col("_n") - F.col("_p")).alias("N")).first()
    P, N = r["P"] or 0, r["N"] or 0
    if P == 0 or N == 0:
        return None
    return (r["rs"] - P * (P + 1) / 2.0) / (P * N)


def auc_frame(df: DataFrame, y: str, score: str, positive=1) -> DataFrame:
    return df.sparkSession.createDataFrame([(auc(df, y, score, positive),)], "auc double")
