"""Classification metrics from a prediction frame, grouped by e.g. dataset and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.operators.ordering import cumulative_by_step, ntiles, running_totals
from featurelens.operators.shared import join_groups, pin_small


def binary_label(label: str) -> Column:
    """A label of 0 or 1 (or null) as an integer; any other value raises, as it would give wrong metrics in silence."""
    y = F.col(label).cast("double")
    return F.when(y.isNull() | y.isin(0.0, 1.0), y.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("a binary metric needs labels 0 and 1, not "), F.col(label).cast("string"))))


def score_table(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: ties become one row."""
    y = binary_label(label)
    return df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def _with_totals(table: DataFrame, by: Sequence[str]) -> DataFrame:
    totals, rows = pin_small(table.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_q")))
    if by:
        return join_groups(table, totals, list(by))
    return table.withColumn("_p", F.lit(rows[0]["_p"])).withColumn("_q", F.lit(rows[0]["_q"]))


def auc(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), **kw) -> DataFrame:
    """Exact area under the ROC curve with mid-ranks for ties; null with one class."""
    by = list(by)
    table = score_table(df, label, score, by)
    return auc_from_table(table, by, **kw)


def auc_from_table(table: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    by = list(by)
    run = _with_totals(running_totals(table, "score", {"cum_neg": F.col("neg")}, by=by, **kw), by)
    below = F.col("_q") - F.col("cum_neg") + F.col("neg") / 2
    return run.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * below), F.max(F.col("_p").cast("double") * F.col("_q"))).alias("auc"))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(prediction)).cast("int")).alias("accuracy"))


def decile_table(df: DataFrame, label: str, score: str, key: str | Sequence[str], by: Sequence[str] = (), n: int = 10, **kw) -> DataFrame:
    """Counts, cumulative shares and spread per score decile (1 = highest scores)."""
    by = list(by)
    keys = [key] if isinstance(key, str) else list(key)
    slim = df.select(*by, *keys, binary_label(label).alias("_y"), F.col(score).cast("double").alias("_s"))
    tiles = ntiles(slim, "_s", keys, by, n, **kw)
    agg = tiles.groupBy(*by, "decile").agg(
        F.count(F.lit(1)).alias("count"), F.sum("_y").alias("target"), F.sum(1 - F.col("_y")).alias("non_target"))
    cum = cumulative_by_step(agg, "decile", ["target", "non_target"], by)
    whole = W.partitionBy(*by)
    t, nt = F.sum("target").over(whole), F.sum("non_target").over(whole)
    out = cum.withColumn("pct_target", F.col("target") / F.col("count") * 100).withColumn(
        "dist_target", F.try_divide(F.col("cum_target"), t) * 100).withColumn(
        "dist_non_target", F.try_divide(F.col("cum_non_target"), nt) * 100)
    return out.withColumn("spread", F.abs(F.col("dist_target") - F.col("dist_non_target")))


def ks(deciles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest decile spread, two decimals."""
    return deciles.groupBy(*by).agg(F.round(F.max("spread"), 2).alias("ks"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score", by: Sequence[str] = (), points: int | None = None, **kw) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score, optionally thinned to about ``points`` steps."""
    by = list(by)
    table = score_table(df, label, score, by)
    run = _with_totals(running_totals(table, "score", {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}, by=by, **kw), by)
    out = run.select(*by, F.col("score").alias("threshold"), F.try_divide("cum_neg", "_q").alias("fpr"),
                     F.try_divide("cum_pos", "_p").alias("tpr"))
    if points is None:
        return out
    # last point of each step of the curve length
    step = F.floor((F.col("fpr") + F.col("tpr")) / 2 * points)
    return out.groupBy(*by, step.alias("_step")).agg(
        F.max_by("threshold", F.struct("fpr", "tpr")).alias("threshold"), F.max("fpr").alias("fpr"), F.max("tpr").alias("tpr")).drop("_step")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """E5: row count per label and prediction."""
    return df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("count"))


def class_scores(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table."""
    by = list(by)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0)
    actual = conf.groupBy(*by, F.col("label").alias("class")).agg(F.sum("count").alias("support"), F.sum(hit).alias("tp"))
    told = conf.groupBy(*by, F.col("prediction").alias("class")).agg(F.sum("count").alias("predicted"))
    out = join_groups(actual, told, [*by, "class"], "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    p = F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))
    r = F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    out = out.withColumn("precision", p).withColumn("recall", r)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def weighted_scores(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1."""
    per = class_scores(conf, by)
    w = F.col("support") / F.lit(1.0)
    total = F.sum("support")
    return per.groupBy(*by).agg(
        (F.sum("tp") / total).alias("accuracy"), (F.sum(w * F.col("f1")) / total).alias("f1"),
        (F.sum(w * F.col("precision")) / total).alias("precision"), (F.sum(w * F.col("recall")) / total).alias("recall"))


def to_metric_rows(wide: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Wide metric columns to ``(*by, metric, value)``."""
    return wide.select(*by, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(by), list(metrics), "metric", "value")


def validate_binary(df: DataFrame, key: str | Sequence[str], label: str = "label", score: str = "score", prediction: str = "prediction",
                    by: Sequence[str] = ("dataset",), **kw) -> DataFrame:
    """Metric rows ``roc``, ``accuracy``, ``ks`` per group, all groups in the same jobs.

    The few columns needed are kept while the metrics are computed, so that the
    model behind the predictions runs once; the metric rows come back pinned.
    """
    by = list(by)
    keys = [key] if isinstance(key, str) else list(key)
    names = list(dict.fromkeys([*by, *keys, label, score, prediction]))
    slim = df.select(*names).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        table = slim.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
            F.sum(binary_label(label)).alias("pos"), F.sum(1 - binary_label(label)).alias("neg"),
            F.count_if(F.col(label) == F.col(prediction)).alias("hit"))
        c = table.groupBy(*by).agg((F.sum("hit") / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"))
        a = auc_from_table(table, by, **kw).withColumnRenamed("auc", "roc")
        k = ks(decile_table(slim, label, score, keys, by, **kw), by)
        return pin_small(to_metric_rows(join_groups(join_groups(a, c, by), k, by), by, ["roc", "accuracy", "ks"]))[0]
    finally:
        slim.unpersist()


def validate_multiclass(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Metric rows accuracy, f1, precision, recall per group."""
    by = list(by)
    return to_metric_rows(weighted_scores(confusion(df, label, prediction, by), by), by, ["accuracy", "f1", "precision", "recall"])
