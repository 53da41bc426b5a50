"""Boosted trees are fitted in tasks of a bounded number of rows."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from featurelens.operators import models as M


def _rows(spark):
    df = spark.range(0, 1000, 1, 1).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("double").alias("label"))
    return VectorAssembler(inputCols=["x"], outputCol="features").transform(df)


def test_large_partitions_are_spread_and_small_ones_kept(spark):
    df = _rows(spark)
    out = M.spread_rows(df, 100)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 200
    assert M.spread_rows(df, 1000) is df
    assert M.spread_rows(df.where("key < 0"), 100).count() == 0


@pytest.mark.parametrize("make", [M.regressor, M.classifier])
def test_boosted_fits_spread_their_rows(spark, monkeypatch, make):
    seen, spread = [], M.spread_rows
    monkeypatch.setattr(M, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(M, "spread_rows", lambda df, most: seen.append(spread(df, most)) or seen[-1])
    model = make("gradient_boosting", maxIter=2).fit(_rows(spark))
    assert seen[0].rdd.getNumPartitions() == 10 and seen[0].columns == ["features", "label"]
    right = model.transform(_rows(spark)).where(F.abs(F.col("prediction") - F.col("label")) < 0.2).count()
    assert right == 1000
