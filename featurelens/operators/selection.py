"""Model choice from metric rows ``(model, dataset, metric, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Fallback order of metrics and stability limits.
CLASS_FALLBACK = ["accuracy", "f1", "precision", "recall", "roc", "ks"]
REGRESSION_FALLBACK = ["rmse", "mae", "r2"]
CLASS_LIMIT, KS_LIMIT = 0.03, 3.0
REGRESSION_LIMITS = {"rmse": 0.1, "mae": 0.05, "r2": 0.02}
OTHER_REGRESSION_LIMIT = 0.05
HIGHER_IS_BETTER = ["ks", "roc", "accuracy", "f1", "precision", "recall", "r2"]
CLUSTER_PRIORITY = ["direct", "validation", "train", "test", "cv"]


def usable_metric(rows: DataFrame, wanted: str, dataset: str, fallback: Sequence[str]) -> str:
    """The wanted metric if the dataset has it, else the first one of the fallback order."""
    have = [r["metric"] for r in rows.where(F.col("dataset") == dataset).select("metric").distinct().orderBy("metric").collect()]
    if not have:
        raise ValueError(f"no metrics for dataset {dataset!r}")
    if wanted in have:
        return wanted
    return next((m for m in fallback if m in have), have[0])


def _ranked(rows: DataFrame, metric: str, dataset: str, limit: float, higher: bool) -> DataFrame:
    of = rows.where(F.col("metric") == metric)
    main = F.max(F.when(F.col("dataset") == dataset, F.col("value"))).over(W.partitionBy("model"))
    marked = of.withColumn("_main", main)
    out = marked.groupBy("model").agg(
        F.max("_main").alias("score"), F.count_if(F.abs(F.col("value") - F.col("_main")) > limit).alias("unstable_datasets"))
    out = out.where(F.col("score").isNotNull())
    order = F.desc("score") if higher else F.asc("score")
    rank = F.row_number().over(W.orderBy("unstable_datasets", order, "model"))     # one row per model
    out = out.withColumn("rank", rank)
    role = F.when(F.col("rank") == 1, "Champion").when(F.col("rank") == 2, "Challenger").otherwise("")
    return out.withColumn("metric", F.lit(metric)).withColumn("role", role)


def champion_classification(rows: DataFrame, metric: str = "ks", dataset: str = "valid") -> DataFrame:
    """MS1: fewest unstable datasets, then the highest metric."""
    m = usable_metric(rows, metric, dataset, CLASS_FALLBACK)
    return _ranked(rows, m, dataset, KS_LIMIT if m == "ks" else CLASS_LIMIT, True)


def champion_regression(rows: DataFrame, metric: str = "rmse", dataset: str = "valid") -> DataFrame:
    """MS2: fewest unstable datasets, then the best metric (lower, but R2 higher)."""
    m = usable_metric(rows, metric, dataset, REGRESSION_FALLBACK)
    return _ranked(rows, m, dataset, REGRESSION_LIMITS.get(m, OTHER_REGRESSION_LIMIT), m == "r2")


def best_clustering(scores: DataFrame, method: str = "silhouette") -> DataFrame:
    """MS3: ``scores`` has ``model, source, value``; the first source of the priority order counts."""
    order = F.array_position(F.array(*[F.lit(s) for s in CLUSTER_PRIORITY]), F.col("source"))
    order = F.when(order > 0, order).otherwise(len(CLUSTER_PRIORITY) + 1)
    first = scores.where(F.col("value").isNotNull()).groupBy("model").agg(F.min_by("value", F.struct(order.alias("o"), "source")).alias("score"))
    lower = method == "davies_bouldin"
    pick = F.min_by if lower else F.max_by
    by = F.struct("score", "model") if lower else F.struct(F.col("score"), F.col("model"))
    return first.agg(pick("model", by).alias("best_model"), (F.min if lower else F.max)("score").alias("best_score"))


def ranking(rows: DataFrame, metric: str, dataset: str = "test", higher: bool | None = None) -> DataFrame:
    """T5: models by one metric on one dataset."""
    up = metric in HIGHER_IS_BETTER if higher is None else higher
    order = F.desc("value") if up else F.asc("value")
    w = W.orderBy(order, "model")       # one row per model
    return rows.where((F.col("metric") == metric) & (F.col("dataset") == dataset)).select("model", "value", F.row_number().over(w).alias("rank"))


def stability(rows: DataFrame, metric: str) -> DataFrame:
    """MS4: mean, population std, CV and range of a metric over the datasets, most stable first."""
    out = rows.where(F.col("metric") == metric).groupBy("model").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"), F.count(F.lit(1)).alias("datasets"))
    return out.withColumn("cv", F.try_divide("std", "mean")).orderBy(F.asc_nulls_last("cv"), "model")


def overfit_gap(rows: DataFrame, metric: str, train: str = "train", valid: str = "valid") -> DataFrame:
    """MS6: relative loss from train to valid, positive when valid is worse."""
    t = F.max(F.when(F.col("dataset") == train, F.col("value")))
    v = F.max(F.when(F.col("dataset") == valid, F.col("value")))
    out = rows.where(F.col("metric") == metric).groupBy("model").agg(t.alias("train_value"), v.alias("valid_value"))
    diff = F.col("train_value") - F.col("valid_value")
    if metric not in HIGHER_IS_BETTER:
        diff = -diff
    gap = F.when(F.col("train_value") == 0, 0.0).otherwise(F.try_divide(diff, F.col("train_value")))
    return out.withColumn("overfit_gap", F.coalesce(gap, F.lit(0.0)))


def _score(rows: DataFrame, dataset: str) -> DataFrame:
    """Score on the chosen dataset, else on train, else any (first by name)."""
    order = F.when(F.col("dataset") == dataset, 0).when(F.col("dataset") == "train", 1).otherwise(2)
    return rows.groupBy("model").agg(F.min_by("value", F.struct(order.alias("o"), "dataset")).alias("score"))


def tuned_or_default(rows: DataFrame, metric: str, default: str = "default", tuned: str = "tuned", dataset: str = "valid",
                     improvement: float = 0.01, overfit: float = 0.05) -> DataFrame:
    """MS5: the tuned model must be better, by the improvement share, without a larger overfit gap."""
    of = rows.where(F.col("metric") == metric)
    both = _score(of, dataset).join(overfit_gap(of, metric), "model", "left")
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    out = both.agg(pick(default, "score").alias("default_score"), pick(tuned, "score").alias("tuned_score"),
                   pick(default, "overfit_gap").alias("default_overfitting"), pick(tuned, "overfit_gap").alias("tuned_overfitting"))
    gain = F.col("tuned_score") - F.col("default_score")
    gain = gain if metric in HIGHER_IS_BETTER else -gain
    pct = F.when(F.col("default_score") != 0, gain / F.abs("default_score") * 100).otherwise(F.lit(0.0))
    out = out.withColumn("improvement_pct", pct)
    decision = (F.when(gain <= 0, "default").when(F.col("improvement_pct") < improvement * 100, "default")
                .when(F.col("tuned_overfitting") > F.col("default_overfitting") + overfit, "default").otherwise("tuned"))
    reason = (F.when(gain <= 0, "not better").when(F.col("improvement_pct") < improvement * 100, "improvement below threshold")
              .when(F.col("tuned_overfitting") > F.col("default_overfitting") + overfit, "more overfitting").otherwise("improved"))
    return out.withColumn("decision", decision).withColumn("reason", reason)


def detailed_comparison(rows: DataFrame) -> DataFrame:
    """MS8: mean, population std, min and max of every metric over the datasets."""
    return rows.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def selection_summary(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """MS9: every metric row with rank and role of its model."""
    return rows.join(chosen.select("model", "rank", "role", "unstable_datasets"), "model", "left")


def choose_k(table: DataFrame) -> DataFrame:
    """MS10: k of the best silhouette; the elbow takes over when more than two k were tried."""
    from featurelens.operators.cluster_metrics import find_elbow
    best = table.agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("silhouette_k"), F.count(F.lit(1)).alias("tried"))
    elbow = find_elbow(table)
    joined = best.withColumn("_k", F.lit(1)).join(elbow.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    use = (F.col("tried") > 2) & F.col("elbow_k").isNotNull()
    return joined.withColumn("best_k", F.when(use, F.col("elbow_k")).otherwise(F.col("silhouette_k")))
