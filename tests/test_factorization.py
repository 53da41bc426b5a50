"""The factorization machine learns in any unit, keeps its columns and survives saving and folds."""

import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import FMRegressionModel
from pyspark.sql import functions as F

from featurelens.operators import factorization, models as M, tune


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for i in range(600):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        out.append((i, Vectors.dense(1000 * a, b / 100), 5e6 + 1e5 * (2 * a - b + 3 * a * b), i % 3))
    return spark.createDataFrame(out, ["key", "features", "label", "fold"]).cache()


def share(predicted):
    return predicted.agg(F.sqrt(F.avg((F.col("label") - F.col("prediction")) ** 2)) / F.stddev_pop("label")).first()[0]


def test_learns_interactions_in_any_unit(rows, tmp_path):
    model = M.regressor("fm_regression").fit(rows)
    predicted = model.transform(rows)
    assert share(predicted) < 0.1 and predicted.columns == [*rows.columns, "prediction"]
    model.write().overwrite().save(str(tmp_path / "fm"))
    assert share(PipelineModel.load(str(tmp_path / "fm")).transform(rows)) == pytest.approx(share(predicted))


def test_folds(rows):
    _, mean, _ = tune.cross_validate(rows, "regression", "fm_regression", 3)
    assert mean > 0


def test_constant_and_missing_labels(rows):
    flat = rows.withColumn("label", F.when(F.col("key") % 7 > 0, F.lit(12.5)))
    got = M.regressor("fm_regression", maxIter=5).fit(flat).transform(flat).agg(F.min("prediction"), F.max("prediction")).first()
    assert got[0] == pytest.approx(12.5, abs=1) and got[1] == pytest.approx(12.5, abs=1)
    with pytest.raises(ValueError, match="label"):
        M.regressor("fm_regression").fit(rows.withColumn("label", F.lit(None).cast("double")))


@pytest.mark.parametrize("options", [{}, {"regParam": 0.01, "maxIter": 20}, {"fitIntercept": False, "fitLinear": False}, {"tol": 0.01}])
def test_same_fit_as_mllib_without_a_pass_for_every_step(rows, options, monkeypatch):
    fast = M.regressor("fm_regression", **options).fit(rows)
    monkeypatch.setattr(factorization, "MAX_TERMS", 0)
    plain = M.regressor("fm_regression", **options).fit(rows)
    assert isinstance(plain.stages[1], FMRegressionModel)
    both = fast.transform(rows).select("key", F.col("prediction").alias("a")).join(plain.transform(rows).select("key", "prediction"), "key").collect()
    assert len(both) == 600 and max(abs(r["a"] - r["prediction"]) for r in both) < 1e-6 * 1e5


def test_rows_are_read_in_few_passes(spark, rows):
    sc = spark.sparkContext
    sc.setJobGroup("fm", "fit")
    try:
        M.regressor("fm_regression").fit(rows)
        jobs = len(sc.statusTracker().getJobIdsForGroup("fm"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 25
