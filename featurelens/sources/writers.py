"""Sinks for predictions, assignments, profiles and fitted pipelines."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_predictions(predictions: dict[str, DataFrame], path: str, columns: Sequence[str]) -> None:
    """One parquet folder per dataset, overwritten."""
    for name, df in predictions.items():
        df.select(*columns).write.mode("overwrite").parquet(f"{path}/{name}")


def flat_vectors(df: DataFrame) -> DataFrame:
    """Vector columns as JSON text, which CSV can hold."""
    return df.withColumns({f.name: F.to_json(vector_to_array(f.name)) for f in df.schema if isinstance(f.dataType, VectorUDT)})


def write_assignments(df: DataFrame, path: str) -> None:
    """Cluster assignments as CSV with header."""
    flat_vectors(df).write.mode("overwrite").option("header", True).csv(path)


def write_profile(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """Every profile table in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: dict) -> None:
    """The fitted pipeline and its metadata as one JSON row."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The counterpart of ``save_model``."""
    text = spark.read.text(f"{path}/metadata").first()["value"]
    return PipelineModel.load(f"{path}/model"), json.loads(text)
