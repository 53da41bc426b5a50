"""A corpus from raw documents: known languages, no repeated lines, one of each near-duplicate, no benchmark, mixed to target weights."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from featurelens.llm import decontam, language, linededup, mixing, simhash
from featurelens.operators.shared import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier accepts; it learns from this stage's own rows outside the held-out fifth."""
    return language.known_language_documents(docs, language.fit_language(language.training_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents with nothing left go."""
    return linededup.deduplicated_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontam.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by weight, each document as often as it is taken."""
    return mixing.mixed_documents(docs)


STAGES = [("language", known_language), ("lines", line_dedup), ("near_duplicates", near_dedup), ("decontamination", decontaminate), ("mix", mix)]

# The language classifier and the fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_dir(spark), f"corpus-{uuid.uuid4().hex[:12]}")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
