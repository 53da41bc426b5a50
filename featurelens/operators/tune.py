"""Hyper-parameter search and cross-validation. Scores come from rows not used to fit."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator,
)
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F

from featurelens.functions.expressions import unit_hash
from featurelens.operators import models as M
from featurelens.operators.dbscan import NOISE
from featurelens.operators.shared import local_frame

# Search spaces per model.
CLASS_SPACE = {
    "logistic": {"maxIter": [10, 20, 50, 100], "regParam": [0.01, 0.1, 0.5, 1.0], "elasticNetParam": [0.0, 0.25, 0.5, 0.75, 1.0]},
    "random_forest": {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
    "decision_tree": {"maxDepth": [3, 5], "minInstancesPerNode": [1, 2], "minInfoGain": [0.0, 0.01]},
    "gradient_boosting": {"maxIter": [5, 10], "maxDepth": [3, 5], "stepSize": [0.1]},
    "neural_network": {"layers": [[8], [16], [8, 4], [16, 8], [16, 8, 4]], "maxIter": [50, 100, 200], "blockSize": [32, 64, 128]},
}
REGRESSION_SPACE = {
    "linear_regression": {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0]},
    "random_forest": {"numTrees": [5, 10], "maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
    "gradient_boosting": {"maxIter": [5, 10], "maxDepth": [3, 5], "stepSize": [0.1], "maxBins": [32, 64]},
    "decision_tree": {"maxDepth": [3, 5], "minInstancesPerNode": [1, 2]},
}
CLUSTER_SPACE = {
    "kmeans": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [20, 50, 100], "initMode": ["k-means||", "random"]},
    "bisecting_kmeans": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [20, 50, 100], "minDivisibleClusterSize": [1.0, 2.0, 3.0]},
    "gaussian_mixture": {"k": [2, 3, 4, 5, 6, 7, 8, 9, 10], "maxIter": [50, 100, 200], "tol": [1e-5, 1e-4, 1e-3]},
}


def grid(space: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def random_maps(space: dict[str, Sequence], n: int, seed: int = 42) -> list[dict]:
    """H2: ``n`` distinct combinations."""
    every = grid(space)
    return random.Random(seed).sample(every, min(n, len(every)))


def builder(task: str, name: str, features: int | None = None, classes: int = 2) -> Callable[..., Estimator]:
    if task == "classification":
        return lambda **p: M.classifier(name, features, classes, **p)
    if task == "regression":
        return lambda **p: M.regressor(name, **p)
    if task == "clustering":
        return lambda k, **p: M.clusterer(name, k, **p)
    raise ValueError(f"unknown task: {task}")


def evaluator(task: str, classes: int = 2):
    """(evaluator, larger is better) for a task."""
    if task == "classification" and classes <= 2:
        return BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="rawPrediction", metricName="areaUnderROC"), True
    if task == "classification":
        return MulticlassClassificationEvaluator(labelCol="label", metricName="accuracy"), True
    if task == "regression":
        return RegressionEvaluator(labelCol="label", metricName="rmse"), False
    return ClusteringEvaluator(metricName="silhouette"), True


def _cluster_score(predictions: DataFrame) -> float:
    """Silhouette, -1 when all rows fall in one cluster."""
    if predictions.select("prediction").distinct().limit(2).count() < 2:
        return -1.0
    return ClusteringEvaluator().evaluate(predictions)


def score_maps(make: Callable[..., Estimator], maps: Sequence[dict], train: DataFrame, valid: DataFrame, ev, parallelism: int = 2,
               task: str = "classification") -> list[tuple[dict, float, Model]]:
    """Fit every parameter map on train and score it on valid; several fits run at a time."""
    @inheritable_thread_target(train.sparkSession)
    def one(p: dict) -> tuple[dict, float, Model]:
        model = make(**p).fit(train)
        pred = model.transform(valid)
        return p, (_cluster_score(pred) if task == "clustering" else ev.evaluate(pred)), model

    with ThreadPool(min(parallelism, max(1, len(maps)))) as pool:
        return pool.map(one, maps)


def _table(spark, results: Sequence[tuple[dict, float, Model]], larger: bool) -> DataFrame:
    rows = [(i, str(dict(sorted(p.items()))), float(s)) for i, (p, s, _) in enumerate(results)]
    order = F.desc("score") if larger else F.asc("score")
    return local_frame(spark, rows, "trial int, params string, score double").orderBy(order, "trial")


def _best(results, larger: bool):
    return (max if larger else min)(results, key=lambda r: r[1])


def grid_search(train: DataFrame, valid: DataFrame, task: str, name: str, space: dict | None = None, features: int | None = None,
                classes: int = 2, parallelism: int = 2, max_grid: int | None = None):
    """H1: all combinations; with ``max_grid`` a larger grid is refused.

    Returns ``(best parameters, best model, trials)``.
    """
    space = space or {"classification": CLASS_SPACE, "regression": REGRESSION_SPACE, "clustering": CLUSTER_SPACE}[task][name]
    maps = grid(space)
    if max_grid is not None and len(maps) > max_grid:
        raise ValueError(f"{len(maps)} combinations exceed max_grid={max_grid}; random_search draws some of them")
    return _search(train, valid, task, name, maps, features, classes, parallelism)


def random_search(train: DataFrame, valid: DataFrame, task: str, name: str, n: int = 20, space: dict | None = None,
                  features: int | None = None, classes: int = 2, parallelism: int = 2, seed: int = 42):
    """H2: ``n`` distinct random combinations."""
    space = space or {"classification": CLASS_SPACE, "regression": REGRESSION_SPACE, "clustering": CLUSTER_SPACE}[task][name]
    return _search(train, valid, task, name, random_maps(space, n, seed), features, classes, parallelism)


def _search(train, valid, task, name, maps, features, classes, parallelism):
    ev, larger = evaluator(task, classes)
    results = score_maps(builder(task, name, features, classes), maps, train, valid, ev, parallelism, task)
    p, _, model = _best(results, larger)
    return p, model, _table(train.sparkSession, results, larger)


def halving_search(train: DataFrame, valid: DataFrame, key: str, task: str, name: str, n: int = 8, space: dict | None = None,
                   features: int | None = None, classes: int = 2, parallelism: int = 2, seed: int = 42, start: float = 0.25):
    """H3: successive halving; each round doubles the key-hash sample and keeps the better half.

    The winner is fitted on all of ``train``.
    """
    space = space or {"classification": CLASS_SPACE, "regression": REGRESSION_SPACE, "clustering": CLUSTER_SPACE}[task][name]
    ev, larger = evaluator(task, classes)
    make = builder(task, name, features, classes)
    alive, fraction, rounds = random_maps(space, n, seed), start, []
    while True:
        part = train if fraction >= 1.0 else train.where(unit_hash(key, seed=seed) < fraction)
        results = score_maps(make, alive, part, valid, ev, parallelism, task)
        results.sort(key=lambda r: r[1], reverse=larger)
        rounds += [(len(rounds), float(min(fraction, 1.0)), str(dict(sorted(p.items()))), float(s)) for p, s, _ in results]
        if len(alive) == 1 or fraction >= 1.0:
            table = local_frame(train.sparkSession, rounds, "trial int, fraction double, params string, score double")
            best, _, model = results[0]
            return best, model if fraction >= 1.0 else make(**best).fit(train), table
        alive = [p for p, _, _ in results[: max(1, len(results) // 2)]]
        fraction *= 2


def use_cross_validation(setting: str, rows: int, has_later_data: bool, min_rows: int = 5000) -> bool:
    """H5 rule: always, never, or auto (no later dataset, or few rows)."""
    if setting in ("always", "never"):
        return setting == "always"
    return not has_later_data or rows < min_rows


def cross_validate(df: DataFrame, task: str, name: str, folds: int = 5, fold_column: str = "fold", features: int | None = None,
                   classes: int = 2, parallelism: int = 2, **params) -> tuple[Model, float, float]:
    """H5: mean and deviation of the fold metric, and the model refitted on all rows."""
    ev, _ = evaluator(task, classes)
    cv = CrossValidator(estimator=builder(task, name, features, classes)(**params), estimatorParamMaps=[{}], evaluator=ev,
                        numFolds=folds, foldCol=fold_column, parallelism=parallelism)
    fitted = cv.fit(df)
    return fitted.bestModel, float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])


def cluster_folds(df: DataFrame, name: str, k: int | None = None, folds: int = 5, fold_column: str = "fold",
                  fit: Callable[[DataFrame], Model] | None = None, **params) -> DataFrame:
    """H7: quality on the held-out fold of models fitted on the other folds, one row per fold.

    ``fit`` replaces the estimator ``name``. Noise counts as no cluster; a fold without clustered rows has no row.
    """
    from featurelens.operators.cluster_metrics import evaluate_clusters
    fit = fit or M.clusterer(name, k, **params).fit
    out = None
    for fold in range(folds):
        held = fit(df.where(F.col(fold_column) != fold)).transform(df.where(F.col(fold_column) == fold))
        part = evaluate_clusters(held.where(F.col("prediction") != NOISE), by=[fold_column])
        out = part if out is None else out.unionByName(part)
    return out


def fold_summary(folds: DataFrame, metrics: Sequence[str] = ("silhouette", "calinski_harabasz", "davies_bouldin", "inertia")) -> DataFrame:
    """H7: mean, population std, min and max of each metric over the folds."""
    long = folds.select(*[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"),
                                      F.max("value").alias("max"), F.count("value").alias("folds"))
