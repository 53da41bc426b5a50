"""Exact tree attribution against all subsets of features, and sums against the model's output."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from featurelens.operators import tree_attribution as TA

NAMES = list("abcde")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    data = []
    for i in range(300):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), rng.random(), rng.gauss(0, 1)]
        y = 2 * x[0] * x[1] + (x[2] == 2) * 3 + x[3]
        data.append((i, *x, y, float(y > 0.8)))
    df = VectorAssembler(inputCols=NAMES, outputCol="_raw").transform(spark.createDataFrame(data, ["key", *NAMES, "y", "label"]))
    # four categories become a categorical split
    return VectorIndexer(inputCol="_raw", outputCol="features", maxCategories=4).fit(df).transform(df).select("key", "features", "y", "label").cache()


MODELS = {
    "tree": (lambda: DecisionTreeClassifier(maxDepth=4, seed=1), lambda d: vector_to_array("probability").getItem(1)),
    "forest": (lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=1), lambda d: vector_to_array("probability").getItem(1)),
    "boosted": (lambda: GBTClassifier(maxIter=5, maxDepth=3, seed=1), lambda d: vector_to_array("rawPrediction").getItem(1)),
    "tree_regressor": (lambda: DecisionTreeRegressor(labelCol="y", maxDepth=5, seed=1), lambda d: F.col("prediction")),
    "forest_regressor": (lambda: RandomForestRegressor(labelCol="y", numTrees=5, maxDepth=4, seed=1), lambda d: F.col("prediction")),
    "boosted_regressor": (lambda: GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1), lambda d: F.col("prediction")),
}


@pytest.mark.parametrize("name", MODELS)
def test_sums_equal_the_output(rows, name):
    estimator, output = MODELS[name]
    model = estimator().fit(rows)
    found = TA.tree_attribution(rows, model, "key", NAMES)
    assert found.count() == 300 * 5
    total = {r["key"]: r["s"] for r in found.groupBy("key").agg(F.sum("attribution").alias("s")).collect()}
    base = TA.base_value(TA.tree_paths(model))
    out = model.transform(rows)
    for r in out.select("key", output(out).alias("v")).collect():
        assert total[r["key"]] + base == pytest.approx(r["v"], abs=1e-9)


def test_equals_all_subsets(rows):
    model = RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=5, seed=3).fit(rows)
    paths = TA.tree_paths(model)
    x = np.array([r["features"].toArray() for r in rows.limit(20).collect()])

    def expected(row, known):
        return sum(p.value * math.prod((float(TA._passes(row[[f]], t)[0]) if f in known else s) for f, t, s in zip(p.features, p.tests, p.shares)) for p in paths)

    got = TA.attribute(x, paths)
    for row, have in zip(x, got):
        for i in range(5):
            rest = [j for j in range(5) if j != i]
            want = sum(math.factorial(k) * math.factorial(4 - k) / math.factorial(5) * (expected(row, {*s, i}) - expected(row, set(s)))
                       for k in range(5) for s in itertools.combinations(rest, k))
            assert have[i] == pytest.approx(want, abs=1e-9)


def test_empty_and_repeated(rows):
    model = DecisionTreeRegressor(labelCol="y", maxDepth=2).fit(rows)
    assert TA.tree_attribution(rows.limit(0), model, "key", NAMES).count() == 0
    twice = rows.where("key = 1").union(rows.where("key = 1"))
    assert TA.tree_attribution(twice, model, "key", NAMES).count() == 10
