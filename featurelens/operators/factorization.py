"""Factorization machine on standardised features and label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.regression import FMRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from featurelens.operators.shared import pin_small

INNER = ("_fm_features", "_fm_label", "_fm_prediction")
# Terms (1, features, products of two features) whose sums of products the driver agrees to hold: 30 features have 466.
MAX_TERMS = 500
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def terms(x: np.ndarray) -> np.ndarray:
    """1, the features and the products of two different ones: a factorization machine is linear in these."""
    i, j = np.triu_indices(x.shape[1], 1)
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def term_sums(df: DataFrame, features: str, label: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows of the products of the terms with each other, and with the label."""
    size = 1 + width + width * (width - 1) // 2
    cells = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            t = terms(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            a += t.T @ t
            b += t.T @ batch.column(1).to_numpy(zero_copy_only=False)
        values = np.concatenate([a[cells], b])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["cell", "value"])

    parts = df.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y")).mapInArrow(add, "cell int, value double")
    _, rows = pin_small(parts.groupBy("cell").agg(F.sum("value").alias("value")))
    values = np.zeros(len(cells[0]) + size)
    for r in rows:
        values[r["cell"]] = r["value"]
    a = np.zeros((size, size))
    a[cells] = a[cells[::-1]] = values[:-size]
    return a, values[-size:]


class FactorizationModel(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted factorization machine; ``factors`` holds the factors of one feature after the other."""

    intercept = Param(Params._dummy(), "intercept", "prediction where all features are 0", typeConverter=TypeConverters.toFloat)
    linear = Param(Params._dummy(), "linear", "weight of each feature", typeConverter=TypeConverters.toListFloat)
    factors = Param(Params._dummy(), "factors", "factors of each feature", typeConverter=TypeConverters.toListFloat)

    def __init__(self, intercept: float = 0.0, linear: list[float] | None = None, factors: list[float] | None = None,
                 featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self._set(intercept=intercept, linear=linear or [], factors=factors or [], featuresCol=featuresCol, predictionCol=predictionCol)

    def _transform(self, df: DataFrame) -> DataFrame:
        start, linear = self.getOrDefault(self.intercept), np.array(self.getOrDefault(self.linear))
        factors = np.array(self.getOrDefault(self.factors)).reshape(len(linear), -1)

        @F.pandas_udf("double")
        def predict(vecs: pd.Series) -> pd.Series:
            x = np.vstack(vecs.to_numpy())
            return pd.Series(start + x @ linear + (((x @ factors) ** 2).sum(axis=1) - (x ** 2 @ factors ** 2).sum(axis=1)) / 2)

        return df.withColumn(self.getPredictionCol(), predict(vector_to_array(self.getFeaturesCol())))


class ScaledFMRegressor(Estimator):
    """A factorization machine, fitted as ``FMRegressor`` does, whose steps do not depend on the units of the data.

    Features are centred and scaled, the label is standardised for the fit, and the prediction is brought back to the label's
    unit by the fitted model, a ``PipelineModel`` that can be saved. A constant label is predicted as it is. Rows without a
    label take no part in the fit.

    The squared error of all rows follows from the sums of products of their terms. So one pass over the rows replaces the
    pass of every step; start, steps and end are those of ``FMRegressor``. That class itself fits tables with more than
    ``MAX_TERMS`` terms, and with options (part of the rows for each step, the other solver) that need the rows each time.
    """

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", predictionCol: str = "prediction", **params) -> None:
        super().__init__()
        self.features, self.label, self.prediction, self.params_of_fit = featuresCol, labelCol, predictionCol, params

    @property
    def params(self) -> list:
        return []

    def copy(self, extra: dict | None = None) -> "ScaledFMRegressor":
        return ScaledFMRegressor(self.features, self.label, self.prediction, **self.params_of_fit)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        features, label, prediction = INNER
        rows = dataset.where(F.col(self.label).isNotNull())
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(self.label).alias("mean"), F.stddev_pop(self.label).alias("std")).first()
        if stats["mean"] is None:
            raise ValueError("no rows with a label")
        mean, std = float(stats["mean"]), float(stats["std"]) or 1.0
        scaler = StandardScaler(inputCol=self.features, outputCol=features, withMean=True, withStd=True).fit(rows)
        ready = scaler.transform(rows).select(features, ((F.col(self.label) - F.lit(mean)) / F.lit(std)).alias(label))
        machine = FMRegressor(featuresCol=features, labelCol=label, predictionCol=prediction, **self.params_of_fit)
        width = len(scaler.mean)
        whole = machine.getMiniBatchFraction() == 1.0 and machine.getSolver() == "adamW"
        few = 1 + width + width * (width - 1) // 2 <= MAX_TERMS
        model = self._descend(machine, ready, width, stats["n"]) if whole and few else machine.fit(ready)
        back = SQLTransformer(statement=f"SELECT * EXCEPT ({features}, {prediction}), {prediction} * {std!r}D + {mean!r}D AS `{self.prediction}` FROM __THIS__")
        return PipelineModel([scaler, model, back])

    @staticmethod
    def _descend(machine: FMRegressor, ready: DataFrame, width: int, n: int) -> FactorizationModel:
        """The steps of ``machine`` (AdamW), with the gradient over all rows from the sums of their terms."""
        features, label, prediction = INNER
        # without steps the machine returns the factors it starts from
        one = ready.sparkSession.createDataFrame([(Vectors.dense([0.0] * width), 0.0)], [features, label])
        start = machine.copy({machine.maxIter: 0}).fit(one).factors.toArray()
        a, b = term_sums(ready, features, label, width)
        i, j = np.triu_indices(width, 1)
        step, keep, tol = machine.getStepSize(), machine.getRegParam(), machine.getTol()
        learned = np.concatenate([np.ones(start.size), np.full(width, float(machine.getFitLinear())), [float(machine.getFitIntercept())]])
        w = np.concatenate([start.ravel(), np.zeros(width + 1)])
        m, v = np.zeros(len(w)), np.zeros(len(w))
        for t in range(1, machine.getMaxIter() + 1):
            factors, linear, intercept = w[:start.size].reshape(start.shape), w[start.size:-1], w[-1]
            slope = 2 * (a @ np.concatenate([[intercept], linear, (factors @ factors.T)[i, j]]) - b) / n
            between = np.zeros((width, width))
            between[i, j] = between[j, i] = slope[1 + width:]
            g = np.concatenate([(between @ factors).ravel(), slope[1:1 + width], slope[:1]]) * learned
            m, v = BETA1 * m + (1 - BETA1) * g, BETA2 * v + (1 - BETA2) * g * g
            new = w - step * (m / (1 - BETA1 ** t)) / (np.sqrt(v / (1 - BETA2 ** t)) + EPSILON) - keep * w
            moved, w = np.linalg.norm(new - w), new
            if t > 1 and moved < tol * max(np.linalg.norm(w), 1.0):
                break
        return FactorizationModel(float(w[-1]), w[start.size:-1].tolist(), w[:start.size].tolist(), features, prediction)
