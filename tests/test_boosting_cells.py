"""Boosted regression fitted by cells is the fit on the rows."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import functions as F

from featurelens.operators import boosting as B, models as M
from featurelens.operators.tree_attribution import tree_paths

NAMES = ["wide", "normal", "few", "mostly_zero", "same"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 4000
    x = np.column_stack([rng.uniform(0, 100, n), rng.normal(size=n), rng.integers(0, 5, n), np.where(rng.random(n) < 0.9, 0, rng.random(n)), np.ones(n)])
    y = x[:, 0] * x[:, 1] + 50 * x[:, 3] + rng.normal(size=n)
    df = spark.createDataFrame([(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))], ["key", *NAMES, "label"])
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).repartition(3).cache()


def _predictions(model, df):
    return df.select("key", "features").transform(model.transform).orderBy("key").toPandas()["prediction"].to_numpy()


def _stats(node):
    own = [*node.impurityStats().stats(), node.impurity(), node.prediction()]
    return [own] if node.subtreeDepth() == 0 else [own, *_stats(node.leftChild()), *_stats(node.rightChild())]


@pytest.mark.parametrize("options", [{}, {"maxBins": 16, "maxDepth": 3}, {"stepSize": 0.5, "minWeightFractionPerNode": 0.05}])
@pytest.mark.parametrize("columns", [["wide", "normal", "mostly_zero"], NAMES])
def test_cells_give_the_trees_of_the_rows(rows, monkeypatch, columns, options):
    df = VectorAssembler(inputCols=columns, outputCol="features").transform(rows.drop("features"))
    plain = GBTRegressor(**{**M.REGRESSORS["gradient_boosting"][1], "maxIter": 4, **options}).fit(df)
    monkeypatch.setattr(M, "ROWS_BY_CELLS", 0)
    model = M.regressor("gradient_boosting", maxIter=4, **options).fit(df)
    assert np.allclose(_predictions(model, df), _predictions(plain, df), rtol=0, atol=1e-9)
    for a, b in zip(model.trees, plain.trees, strict=True):
        assert np.allclose(_stats(a._java_obj.rootNode()), _stats(b._java_obj.rootNode()), rtol=1e-9, atol=1e-6)
    assert model.treeWeights == plain.treeWeights and model.numFeatures == len(columns)


def test_rounds_read_cells_instead_of_rows(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 + F.col("id") % 3).cast("double").alias("label"))
    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    seen, fit = [], GBTRegressor._fit
    monkeypatch.setattr(M, "ROWS_BY_CELLS", 100, raising=False)
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, data: seen.append(data.count()) or fit(self, data))
    model = M.regressor("gradient_boosting", maxIter=2).fit(df)
    assert seen == [20]
    assert model.trees[0]._java_obj.rootNode().impurityStats().count() == 1000


def test_the_model_is_spark_own(rows, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "ROWS_BY_CELLS", 0)
    model = M.regressor("gradient_boosting", label="goal", maxIter=3, maxDepth=2).fit(rows.withColumnRenamed("label", "goal"))
    assert type(model) is GBTRegressionModel and (model.getLabelCol(), model.getFeaturesCol(), model.getMaxBins()) == ("goal", "features", 64)
    model.save(str(tmp_path / "model"))
    assert np.array_equal(_predictions(GBTRegressionModel.load(str(tmp_path / "model")), rows), _predictions(model, rows))
    assert sum(len(p.features) > 0 for p in tree_paths(model)) > 3


def test_fits_that_need_the_rows_keep_them(spark, rows, monkeypatch):
    by = lambda df=rows, **p: M.regressor("gradient_boosting", **p)._by_cells(df)
    flagged = rows.select("features", "label", F.lit(1.0).alias("w"), F.lit(False).alias("v"))
    kinds = VectorAssembler(inputCols=["few"], outputCol="features").transform(
        rows.select("label", F.col("few").alias("few", metadata={"ml_attr": {"type": "nominal", "vals": list("abcde")}})))
    assert by()
    assert not any([by(subsamplingRate=0.5), by(lossType="absolute"), by(minInstancesPerNode=5), by(featureSubsetStrategy="2"), by(flagged, weightCol="w"),
                    by(flagged, validationIndicatorCol="v"), by(kinds)])


@pytest.mark.parametrize("name,value", [("label", None), ("label", "NaN"), ("wide", "NaN"), ("wide", "Infinity")])
@pytest.mark.parametrize("limit", [0, 10 ** 9])
def test_missing_labels_and_values_are_refused(rows, monkeypatch, name, value, limit):
    monkeypatch.setattr(M, "ROWS_BY_CELLS", limit)
    bad = rows.drop("features").withColumn(name, F.when(F.col("key") == 7, F.lit(value).cast("double")).otherwise(F.col(name)))
    df = VectorAssembler(inputCols=NAMES, outputCol="features", handleInvalid="keep").transform(bad)
    with pytest.raises(Exception):
        M.regressor("gradient_boosting", maxIter=1).fit(df)


def test_thinned_values_keep_their_ranks():
    rng = np.random.default_rng(3)
    x = np.sort(np.r_[rng.exponential(size=50_000), np.zeros(20_000), np.full(5_000, 1.5)])
    values, counts = np.zeros(0), np.zeros(0, np.int64)
    for part in np.array_split(rng.permutation(x), 5):
        v, n = np.unique(part, return_counts=True)
        values, counts = B.thinned(np.r_[values, v], np.r_[counts, n], 2000)
        assert len(values) <= 2000 and (np.diff(values) > 0).all()
    assert counts.sum() == len(x)
    true = np.searchsorted(x, values, side="right")
    assert np.abs(np.cumsum(counts) - true).max() <= 5 * len(x) / 2000
    few, n = B.thinned(np.array([3.0, 1.0, 3.0]), np.array([1, 2, 4]), 2)
    assert few.tolist() == [1, 3] and n.tolist() == [2, 5]


def test_borders_share_the_rows():
    values = np.arange(1000.0)
    borders = B.borders_of(values, np.ones(1000, np.int64), 10)
    assert borders == [99.5, 199.5, 299.5, 399.5, 499.5, 599.5, 699.5, 799.5, 899.5]
    assert B.borders_of(values[:10], np.arange(1, 11), 10) == [i + 0.5 for i in range(9)]
    assert B.borders_of(values[:1], np.array([5]), 10) == []
