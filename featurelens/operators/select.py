"""Feature selection: tree importances, variance and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from featurelens.functions.expressions import as_double, field_type
from featurelens.operators.moments import co_moments, correlation, variance
from featurelens.operators.shared import local_frame

MIN_VARIANCE = 1e-6
IMPORTANCE_SCHEMA = "feature string, importance double"


def statistics_table(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Variance and target correlation of every feature, from one scan of all columns."""
    pairs = co_moments(df, features, [target])
    return pairs.groupBy(F.col("feature1").alias("feature")).agg(F.max(F.when(F.col("own"), variance())).alias("variance"),
                                                                F.max(F.when(~F.col("own"), correlation())).alias("correlation"))


def statistical_selection(df: DataFrame, features: Sequence[str], target: str, n: int) -> DataFrame:
    """FS4: variance over 1e-6, then the ``n`` largest |correlation| with the target."""
    table = statistics_table(df, features, target).where(F.col("variance") > MIN_VARIANCE)
    # one row per feature
    w = W.orderBy(F.desc_nulls_last(F.abs("correlation")), "feature")
    return table.select("feature", "variance", "correlation", F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def variance_selection(df: DataFrame, features: Sequence[str], n: int) -> DataFrame:
    """FS5: the ``n`` largest variances with their share of the total."""
    table = co_moments(df, features, []).select(F.col("feature1").alias("feature"), variance().alias("variance"))
    w = W.orderBy(F.desc_nulls_last("variance"), "feature")
    total = F.sum("variance").over(W.partitionBy())
    return table.select("feature", "variance", F.coalesce(F.try_divide("variance", total), F.lit(1.0 / len(features))).alias("importance"),
                        F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def forest_size(features: int) -> tuple[int, int]:
    """FS2: (trees 5-10, depth 3-10) for a number of features."""
    return min(10, max(5, 50 // max(1, features // 50))), min(10, max(3, 20 - features // 20))


def importance_table(spark, features: Sequence[str], importances) -> DataFrame:
    """FS6/FS8: importance per feature name, largest first."""
    rows = [(f, float(importances[i])) for i, f in enumerate(features)]
    return local_frame(spark, rows, IMPORTANCE_SCHEMA).orderBy(F.desc("importance"), "feature")


def _forest(df: DataFrame, features: Sequence[str], label: str, task: str, seed: int, **params):
    cls = RandomForestClassifier if task == "classification" else RandomForestRegressor
    slim = df.select(F.col(label).cast("double").alias("label"),
                     *[F.coalesce(as_double(f, field_type(df, f)), F.lit(-999.0)).alias(f) for f in features])
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(slim).select("label", "features")
    return cls(featuresCol="features", labelCol="label", seed=seed, **params).fit(vec)


def forest_importance(df: DataFrame, features: Sequence[str], label: str, task: str = "classification", seed: int = 42, prefilter: int | None = None, **params) -> DataFrame:
    """FS2: forest importances of all features on all rows; ``prefilter`` first keeps that many by FS4, on request."""
    features = list(features)
    if prefilter is not None and len(features) > prefilter:
        kept = {r["feature"] for r in statistical_selection(df, features, label, prefilter).collect()}
        features = [f for f in features if f in kept]
    if not features:
        raise ValueError("no usable features")
    trees, depth = forest_size(len(features))
    model = _forest(df, features, label, task, seed, **{"numTrees": trees, "maxDepth": depth, **params})
    return importance_table(df.sparkSession, features, model.featureImportances)


def threshold_selection(df: DataFrame, features: Sequence[str], label: str, task: str = "classification", threshold: float = 0.01,
                        most: int = 50, fallback: int = 10, seed: int = 42) -> DataFrame:
    """FS1: importance at least ``threshold``, at most ``most``; with none, the best ``fallback``."""
    model = _forest(df, features, label, task, seed, numTrees=10, maxDepth=5, maxBins=100)
    table = importance_table(df.sparkSession, features, model.featureImportances)
    good = table.where(F.col("importance") >= threshold).limit(most)
    return good if not good.isEmpty() else table.limit(fallback)


def top_features(table: DataFrame, n: int) -> list[str]:
    """Names of the ``n`` most important features."""
    return [r["feature"] for r in table.orderBy(F.desc("importance"), "feature").limit(n).collect()]


def chunked_selection(df: DataFrame, features: Sequence[str], label: str, most: int, task: str = "classification", chunk: int = 100,
                      per_chunk: int | None = None, seed: int = 42) -> list[str]:
    """FS3: the best of every chunk of columns, repeated until at most ``most`` remain.

    A pass that removes nothing ends the loop with one last ranking.
    """
    left = list(features)
    take = per_chunk or max(1, most // 2)
    while len(left) > most:
        kept: list[str] = []
        for i in range(0, len(left), chunk):
            part = left[i:i + chunk]
            kept += part if len(part) <= take else top_features(forest_importance(df, part, label, task, seed), take)
        if len(kept) >= len(left):
            return top_features(forest_importance(df, left, label, task, seed), most)
        left = kept
    return left


def select_features(df: DataFrame, features: Sequence[str], label: str, task: str = "classification", most: int = 30,
                    strategy: str = "forest", seed: int = 42) -> list[str]:
    """FS7: the ``most`` best features by ``strategy``: forest (all features at once), chunked (FS3) or statistical (FS4)."""
    if len(features) <= most:
        return list(features)
    if strategy == "chunked":
        return chunked_selection(df, features, label, most, task, seed=seed)
    if strategy == "statistical":
        return [r["feature"] for r in statistical_selection(df, features, label, most).orderBy("rank").collect()]
    if strategy != "forest":
        raise ValueError(f"unknown strategy: {strategy}")
    return top_features(forest_importance(df, features, label, task, seed), most)


def audit_trail(spark, columns: dict[str, str], dropped: Sequence[tuple[str, str, str]], selected: Sequence[str]) -> DataFrame:
    """FS9: ``variable, data_type, status, drop_step, reason, selected`` per column."""
    why = {c: (s, r) for c, s, r in dropped}
    rows = [(c, t, "dropped" if c in why else "kept", *(why.get(c, (None, None))), c in set(selected)) for c, t in columns.items()]
    return local_frame(spark, rows, T.StructType([
        T.StructField("variable", T.StringType()), T.StructField("data_type", T.StringType()), T.StructField("status", T.StringType()),
        T.StructField("drop_step", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("selected", T.BooleanType())]))


def audit_summary(trail: DataFrame) -> DataFrame:
    """FS9: variables per step and reason."""
    return trail.groupBy("status", F.coalesce("drop_step", F.lit("")).alias("drop_step"), F.coalesce("reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("variables"), F.count_if("selected").alias("selected"))
