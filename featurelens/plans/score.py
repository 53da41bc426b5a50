"""Batch scoring with one fitted pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from featurelens.operators.cluster_metrics import silhouette
from featurelens.operators.dbscan import NOISE
from featurelens.operators.transform import check_columns
from featurelens.sources.readers import load_source
from featurelens.sources.writers import load_model


def score_classification(model: PipelineModel, df: DataFrame, required: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Prediction, its probability and (two classes) the positive-class score."""
    check_columns(df, [*required, *keys])
    out = model.transform(df)
    p = vector_to_array("probability")
    named = [c for c in out.columns if c.startswith("predicted_")]
    return out.select(*keys, "prediction", *named, F.array_max(p).alias("confidence"), F.get(p, F.lit(1)).alias("score"))


def with_residuals(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Residual and absolute error beside the prediction."""
    e = F.col(target) - F.col(prediction)
    return df.withColumn("residual", e).withColumn("absolute_error", F.abs(e))


def score_regression(model: PipelineModel, df: DataFrame, required: Sequence[str], keys: Sequence[str] = (), target: str | None = None) -> DataFrame:
    """Prediction and, with a known target, the errors."""
    check_columns(df, [*required, *keys])
    out = model.transform(df)
    if target is None or target not in df.columns:
        return out.select(*keys, "prediction")
    return with_residuals(out.select(*keys, target, "prediction"), target)


def score_clusters(model: PipelineModel, df: DataFrame, required: Sequence[str], keys: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Assignments (with the original columns) and a summary with sizes and silhouette (without noise)."""
    check_columns(df, [*required, *keys])
    out = model.transform(df)
    sizes = out.groupBy("prediction").agg(F.count(F.lit(1)).alias("size"))
    quality = silhouette(out.where(F.col("prediction") != NOISE)).withColumn("_k", F.lit(1))
    return out, sizes.withColumn("_k", F.lit(1)).join(quality, "_k").drop("_k")


def score(spark: SparkSession, model_path: str, source: str | DataFrame, out_path: str) -> None:
    """The scoring job: saved pipeline in, parquet of keys and predictions out."""
    model, meta = load_model(spark, model_path)
    df, _ = load_source(spark, source)
    keys = [meta["key"]] if meta.get("key") else []
    if meta["task"] == "classification":
        out = score_classification(model, df, meta["required"], keys)
    elif meta["task"] == "regression":
        out = score_regression(model, df, meta["required"], keys, meta.get("target"))
    else:
        out = score_clusters(model, df, meta["required"], keys)[0].select(*keys, "prediction")
    out.write.mode("overwrite").parquet(out_path)
