"""Boosted regression from the cells of the rows.

Trees see a feature only through its bins, ``maxBins`` at most. With squared error the rows of a cell (those with the same bin
of every feature) have the same prediction in every round, so count, mean and deviation of their labels are all that a split or
a leaf needs of them. Two passes over the rows, one for the borders of the bins and one for the cells, replace the passes of
every level of every tree. How many rows share a cell only decides what that saves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, functions as F

# Values that stand for the distribution of a feature (``GBTRegressor`` takes the values of 10 000 rows).
POINTS = 10_000
# Feature values that a task counts at a time.
BATCH_NUMBERS = 4_000_000
CELL, FEATURES, LABEL, WEIGHT = "_cell", "_cell_features", "_cell_label", "_cell_weight"


def thinned(values: np.ndarray, counts: np.ndarray, most: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with counts; more than ``most`` become runs of about equal count, each at its last value."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    values, counts = values[starts], np.add.reduceat(counts, starts)
    if len(values) <= most:
        return values, counts
    before = np.cumsum(counts) - counts
    run = before * most // counts.sum()
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    return values[np.r_[starts[1:], len(values)] - 1], np.add.reduceat(counts, starts)


def borders_of(values: np.ndarray, counts: np.ndarray, bins: int) -> list[float]:
    """The split values that ``GBTRegressor`` finds for a feature: between all values that are few, else after equal shares."""
    middle = ((values[:-1] + values[1:]) / 2).tolist()
    if len(middle) < bins:
        return middle
    share = float(counts.sum()) / bins
    found, seen, target = [], float(counts[0]), share
    for border, count in zip(middle, counts[1:].tolist()):
        before, seen = seen, seen + count
        if abs(before - target) < abs(seen - target):
            found.append(border)
            target += share
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; refuses what ``GBTRegressor`` refuses."""
    width = len(column[0]) if column[0].is_valid else 0
    if column.null_count or (column.value_lengths().to_numpy() != width).any():
        raise ValueError("feature vectors must not be null and must have one size")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    if not np.isfinite(x).all():
        raise ValueError("feature vectors must not hold NaN or infinity")
    return x


def bin_borders(df: DataFrame, features: str, bins: int) -> list[list[float]]:
    """Borders between the bins of every feature, from the values of all rows; bin i ends with border i."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[np.ndarray] = []

        def add() -> None:
            x = np.vstack(waiting)
            waiting.clear()
            kept[:] = kept or [(x[:0, j], np.zeros(0, np.int64)) for j in range(x.shape[1])]
            for j, (values, counts) in enumerate(kept):
                more, n = np.unique(x[:, j], return_counts=True)
                kept[j] = thinned(np.r_[values, more], np.r_[counts, n])

        for batch in batches:
            if batch.num_rows:
                waiting.append(_matrix(batch.column(0)))
                if sum(x.size for x in waiting) >= BATCH_NUMBERS:
                    add()
        if waiting:
            add()
        for j, (values, counts) in enumerate(kept):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), j, np.int32)), pa.array(values), pa.array(counts)], names=["feature", "value", "n"])

    def cut(points: pd.DataFrame) -> pd.DataFrame:
        values, counts = thinned(points["value"].to_numpy(), points["n"].to_numpy())
        return pd.DataFrame({"feature": [points["feature"].iloc[0]], "borders": [borders_of(values, counts, bins)]})

    points = df.select(vector_to_array(features).alias("x")).mapInArrow(count, "feature int, value double, n bigint")
    rows = points.groupBy("feature").applyInPandas(cut, "feature int, borders array<double>").collect()
    return [r["borders"] for r in sorted(rows, key=lambda r: r["feature"])]


def _key_type(borders: Sequence[Sequence[float]]) -> np.dtype:
    return np.min_scalar_type(max((len(b) for b in borders), default=0))


def cells(df: DataFrame, features: str, label: str, borders: Sequence[Sequence[float]]) -> DataFrame:
    """One row per cell that holds rows: its bins as bytes, and count, mean and deviation of the labels."""
    edges, kind = [np.array(b, float) for b in borders], _key_type(borders)
    size = kind.itemsize * len(edges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column(0)), batch.column(1)
            if y.null_count or np.isnan(y.to_numpy()).any():
                raise ValueError("labels must not be null or NaN")
            key = np.empty(x.shape, kind)
            for j, edge in enumerate(edges):
                key[:, j] = np.searchsorted(edge, x[:, j])
            ends = np.arange(len(x) + 1, dtype=np.int32) * size
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(key)]), y], names=[CELL, LABEL])

    rows = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(place, f"{CELL} binary, {LABEL} double")
    return rows.groupBy(CELL).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(LABEL).alias("mean"), F.stddev_pop(LABEL).alias("std"))


def cell_rows(held: DataFrame, borders: Sequence[Sequence[float]]) -> DataFrame:
    """Weighted rows of the cells: bin numbers as features, and labels with the count, the sum and the sum of squares of the cell's own.

    A cell whose labels differ is two rows of half its count, its deviation under and over its mean.
    """
    width, kind = len(borders), _key_type(borders)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).reshape(-1, width)
            n, mean, std = (batch.column(i).to_numpy() for i in (1, 2, 3))
            two = np.flatnonzero(std > 0)
            at = np.r_[np.arange(len(n)), two]
            weight = np.where(std > 0, n / 2, n)[at]
            y = np.r_[mean - np.where(std > 0, std, 0), (mean + std)[two]]
            bins = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * width, key[at].astype(float).ravel())
            yield pa.RecordBatch.from_arrays([bins, pa.array(y), pa.array(weight)], names=["x", LABEL, WEIGHT])

    rows = held.mapInArrow(unfold, f"x array<double>, {LABEL} double, {WEIGHT} double")
    return rows.select(array_to_vector("x").alias(FEATURES), LABEL, WEIGHT)


def bins_for(rows: int, bins: int) -> int:
    """``GBTRegressor`` looks for bins in at least the square of ``maxBins`` rows: the number at which it leaves no bin out."""
    return max(bins, math.isqrt(rows) + 1)


def with_borders(model: GBTRegressionModel, borders: Sequence[Sequence[float]]) -> GBTRegressionModel:
    """A model fitted on bin numbers as the same trees on the values of the features."""
    context = SparkContext._active_spark_context
    ml = context._jvm.org.apache.spark.ml

    def node(old):
        if old.subtreeDepth() == 0:
            return old
        feature = old.split().featureIndex()
        split = ml.tree.ContinuousSplit(feature, borders[feature][int(old.split().threshold())])
        return ml.tree.InternalNode(old.prediction(), old.impurity(), old.gain(), node(old.leftChild()), node(old.rightChild()), split, old.impurityStats())

    weights, width = model.treeWeights, len(borders)
    trees, shares = context._gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(weights)), context._gateway.new_array(context._jvm.double, len(weights))
    for i, tree in enumerate(model._java_obj.trees()):
        trees[i], shares[i] = ml.regression.DecisionTreeRegressionModel(tree.uid(), node(tree.rootNode()), width), weights[i]
    return GBTRegressionModel(ml.regression.GBTRegressionModel(model.uid, trees, shares, width))
