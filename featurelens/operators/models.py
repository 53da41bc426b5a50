"""Default estimators per task. All train distributed; parameters can be overridden by keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from featurelens.operators import boosting as B
from featurelens.operators.factorization import ScaledFMRegressor

# Rows that one task of a boosted fit stores and reads again in every round (about 300 bytes a row).
ROWS_PER_TASK = 1_000_000
# Rows above which a boosted regression is fitted by cells.
ROWS_BY_CELLS = 100_000


def spread_rows(df: DataFrame, most: int) -> DataFrame:
    """``df`` in partitions of about ``most`` rows if one of its own holds more."""
    sizes = df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    return df.repartition(-(-row["rows"] // most)) if (row["largest"] or 0) > most else df


class _SpreadRows:
    """Fits on all rows, spread over as many tasks as they need: file splits follow bytes, and a well compressed file has many rows in each."""

    def _fit(self, dataset: DataFrame) -> Model:
        used = [self.getOrDefault(p) for p in (self.featuresCol, self.labelCol, self.weightCol, self.validationIndicatorCol) if self.isDefined(p)]
        return super()._fit(spread_rows(dataset.select(*[c for c in used if c]), ROWS_PER_TASK))


class SpreadGBTClassifier(_SpreadRows, GBTClassifier):
    """Boosted trees in tasks of a bounded number of rows."""


class SpreadGBTRegressor(_SpreadRows, GBTRegressor):
    """Boosted trees in tasks of a bounded number of rows; many rows are fitted by the cells of their bins.

    Cells stand for the rows with squared error, all rows alike, numeric features and no draws of features (a draw depends on the nodes
    before, and so on rounding). The other fits read the rows in every round.
    """

    def _by_cells(self, dataset: DataFrame) -> bool:
        kinds = dataset.select(self.getFeaturesCol()).schema[0].metadata.get("ml_attr", {}).get("attrs", {})
        alike = self.getSubsamplingRate() == 1.0 and self.getMinInstancesPerNode() == 1 and not any(
            self.isDefined(p) and self.getOrDefault(p) for p in (self.weightCol, self.validationIndicatorCol))
        alike &= self.getFeatureSubsetStrategy() in ("all", "auto")
        return alike and self.getLossType() == "squared" and not {"nominal", "binary"} & set(kinds)

    def _fit(self, dataset: DataFrame) -> Model:
        if not self._by_cells(dataset) or dataset.count() <= ROWS_BY_CELLS:
            return super()._fit(dataset)
        features = self.getFeaturesCol()
        borders = B.bin_borders(dataset, features, self.getMaxBins())
        held = B.cells(dataset, features, self.getLabelCol(), borders).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            names = {self.featuresCol: B.FEATURES, self.labelCol: B.LABEL, self.weightCol: B.WEIGHT, self.maxBins: B.bins_for(2 * held.count(), self.getMaxBins())}
            model = GBTRegressor._fit(self.copy(names), B.cell_rows(spread_rows(held, ROWS_PER_TASK), borders))
        finally:
            held.unpersist()
        return self._copyValues(B.with_borders(model, borders))


# Default parameters of each model.
CLASSIFIERS = {
    "logistic": (LogisticRegression, {"maxIter": 10}),
    "random_forest": (RandomForestClassifier, {"numTrees": 10, "seed": 42}),
    "gradient_boosting": (SpreadGBTClassifier, {"maxIter": 50, "maxDepth": 5, "maxBins": 64, "seed": 42}),
    "decision_tree": (DecisionTreeClassifier, {"maxDepth": 5, "seed": 42}),
    "neural_network": (MultilayerPerceptronClassifier, {"maxIter": 100, "blockSize": 512, "seed": 12345}),
}
REGRESSORS = {
    "linear_regression": (LinearRegression, {"regParam": 0.01, "elasticNetParam": 0.0}),
    "random_forest": (RandomForestRegressor, {"numTrees": 100, "maxDepth": 5, "maxBins": 256, "seed": 42}),
    "gradient_boosting": (SpreadGBTRegressor, {"maxIter": 50, "maxDepth": 5, "maxBins": 64, "seed": 42}),
    "decision_tree": (DecisionTreeRegressor, {"maxDepth": 5, "maxBins": 256, "seed": 42}),
    "fm_regression": (ScaledFMRegressor, {"factorSize": 8, "stepSize": 0.05, "maxIter": 100, "seed": 42}),
}
CLUSTERERS = {
    "kmeans": (KMeans, {"seed": 42}),
    "bisecting_kmeans": (BisectingKMeans, {"seed": 42}),
    "gaussian_mixture": (GaussianMixture, {"seed": 42}),
}
BINARY_ONLY = ["gradient_boosting"]


def hidden_units(features: int) -> int:
    """M5: 8, 16 or 32 hidden units for up to 10, up to 20 or more features."""
    return 8 if features <= 10 else 16 if features <= 20 else 32


def classifier(name: str, features: int | None = None, classes: int = 2, label: str = "label", **params) -> Estimator:
    """M1-M5."""
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classifier: {name}")
    if name in BINARY_ONLY and classes > 2:
        raise ValueError(f"{name} needs a two-class target")
    cls, defaults = CLASSIFIERS[name]
    options = {**defaults, **params}
    if name == "neural_network":
        hidden = options.pop("layers", None)
        if hidden is None or len(hidden) < 3 or hidden[0] != features:
            if features is None:
                raise ValueError("neural_network needs the number of features")
            options["layers"] = [features, *(hidden or [hidden_units(features)]), classes]
        else:
            options["layers"] = hidden
    return cls(featuresCol="features", labelCol=label, **options)


def regressor(name: str, label: str = "label", **params) -> Estimator:
    """M6-M10."""
    if name not in REGRESSORS:
        raise ValueError(f"unknown regressor: {name}")
    cls, defaults = REGRESSORS[name]
    return cls(featuresCol="features", labelCol=label, **{**defaults, **params})


def clusterer(name: str, k: int, **params) -> Estimator:
    """M11-M13."""
    if name not in CLUSTERERS:
        raise ValueError(f"unknown clusterer: {name}")
    cls, defaults = CLUSTERERS[name]
    return cls(featuresCol="features", predictionCol="prediction", k=k, **{**defaults, **params})


def with_score(predictions: DataFrame, output: str = "score") -> DataFrame:
    """Positive-class probability as a plain column."""
    return predictions.withColumn(output, vector_to_array("probability").getItem(1))


def fit_k_range(df: DataFrame, name: str, k_range: Sequence[int], **params) -> tuple[dict[int, Model], DataFrame]:
    """M11 + E25: one model per k and the elbow table with its quality figures."""
    from featurelens.operators.cluster_metrics import evaluate_clusters
    models: dict[int, Model] = {}
    table = None
    for k in k_range:
        models[k] = clusterer(name, k, **params).fit(df)
        part = evaluate_clusters(models[k].transform(df).withColumn("k", F.lit(k)), by=["k"])
        table = part if table is None else table.unionByName(part)
    if table is None:
        raise ValueError("empty k range")
    return models, table.select("k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin", "num_clusters")
