"""Exact attribution of tree models: the Shapley values of the path-dependent expectation."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from featurelens.functions.expressions import unit_hash

TREES = ["decision_tree", "random_forest", "gradient_boosting"]
BATCH_NUMBERS = 4_000_000


@dataclass
class Path:
    """A leaf: its value and, for each feature on the way, the tests a row must pass and the share of training rows that do."""
    value: float
    features: list[int]
    tests: list[list[tuple[float | None, frozenset, bool]]]
    shares: list[float]


def _paths(root, weight: float, value_of) -> Iterator[Path]:
    stack = [(root, {})]
    while stack:
        node, seen = stack.pop()
        if node.subtreeDepth() == 0:
            names = sorted(seen)
            yield Path(weight * value_of(node), names, [seen[f][0] for f in names], [seen[f][1] for f in names])
            continue
        split, total = node.split(), float(node.impurityStats().count())
        f = split.featureIndex()
        continuous = split.getClass().getSimpleName() == "ContinuousSplit"
        threshold = float(split.threshold()) if continuous else None
        cats = frozenset() if continuous else frozenset(split.leftCategories())
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            tests, share = seen.get(f, ([], 1.0))
            part = float(child.impurityStats().count()) / total if total else 0.0
            stack.append((child, {**seen, f: ([*tests, (threshold, cats, left)], share * part)}))


def tree_paths(model: Model) -> list[Path]:
    """All leaves of a tree, forest or boosted model; their values add up to the model's output.

    The output is the probability of class 1 for a classification tree or forest, the margin for boosted classification (half the
    log odds) and the prediction for regression.
    """
    boosted = type(model).__name__.startswith("GBT")
    voting = hasattr(model, "numClasses") and not boosted
    trees = list(model.trees) if hasattr(model, "trees") else [model]
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)

    def probability(node) -> float:
        stats = [float(v) for v in node.impurityStats().stats()]
        return stats[1] / sum(stats)

    value_of = probability if voting else lambda node: float(node.prediction())
    return [p for tree, w in zip(trees, weights) for p in _paths(tree._java_obj.rootNode(), w, value_of)]


def _passes(x: np.ndarray, tests: list[tuple[float | None, frozenset, bool]]) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for threshold, cats, left in tests:
        goes = np.isin(x, list(cats)) if threshold is None else x <= threshold
        ok &= goes if left else ~goes
    return ok


def attribute(x: np.ndarray, paths: Sequence[Path]) -> np.ndarray:
    """Shapley values, rows by features.

    Of a leaf, a set of known features expects its value times a product over the features of its path: whether the row passes, if known,
    else the share of rows that do. The sums over sets of one size are the coefficients of a polynomial, so a leaf of m
    features costs m steps of m numbers for each feature instead of 2 ** m sets.
    """
    out = np.zeros(x.shape)
    for path in paths:
        m = len(path.features)
        passed = [_passes(x[:, f], t).astype(float) for f, t in zip(path.features, path.tests)]
        for i, f in enumerate(path.features):
            # coefficient k: the sum over sets of k other known features
            poly = np.zeros((m, len(x)))
            poly[0] = 1.0
            for j in range(m):
                if j != i:
                    poly[1:] = poly[1:] * path.shares[j] + poly[:-1] * passed[j]
                    poly[0] *= path.shares[j]
            chances = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
            out[:, f] += path.value * (passed[i] - path.shares[i]) * (chances @ poly)
    return out


def base_value(paths: Sequence[Path]) -> float:
    """The output expected with no feature known."""
    return float(sum(p.value * math.prod(p.shares) for p in paths))


def tree_attribution(df: DataFrame, model: Model, key: str, features: Sequence[str], vector: str = "features", max_rows: int | None = None, seed: int = 42) -> DataFrame:
    """``key, feature, attribution`` of every row, or of ``max_rows`` rows drawn by key hash.

    A row's attributions and the base value add up to the model's output.

    The leaves of the model travel in the task; rows come in Arrow batches and never meet. Rows without features give none; rows
    that repeat a key give their values again. An empty table gives no rows.
    """
    names, paths = list(features), tree_paths(model)
    step = max(1, BATCH_NUMBERS // max(1, 32 * len(names)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                got = attribute(np.vstack(part["_x"].to_numpy()).astype(float), paths)
                yield pd.DataFrame({key: np.repeat(part["_key"].to_numpy(), len(names)), "feature": names * len(part), "attribution": got.ravel()})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), vector_to_array(vector).alias("_x"))
    if max_rows is not None:
        rows = rows.orderBy(unit_hash("_key", seed=seed), "_key").limit(max_rows)
    kind = df.schema[key].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, feature string, attribution double")
