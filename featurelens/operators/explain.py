"""Feature attribution of a fitted model."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window as W, functions as F

from featurelens.functions.expressions import unit_hash


def shapley(df: DataFrame, model: Model, key: str, features: Sequence[str], vector: str = "features", max_rows: int | None = None,
            permutations: int = 10, seed: int = 42) -> DataFrame:
    """``key, feature, attribution`` of all rows, or of ``max_rows`` rows drawn by key hash.

    For each row and feature order the features are switched one by one from
    the column mean to the row value; the change of the model output is the
    share of the feature. All probes go through one ``transform``.
    """
    d = len(features)
    arr = vector_to_array(vector)
    mean = df.agg(F.array(*[F.avg(arr.getItem(i)) for i in range(d)]).alias("m")).first()["m"]
    rows = df.select(F.col(key).alias("_key"), arr.alias("_x"))
    if max_rows is not None:
        rows = rows.orderBy(unit_hash("_key", seed=seed), "_key").limit(max_rows)
    rng = random.Random(seed)
    orders = []
    for _ in range(permutations):
        order = list(range(d))
        rng.shuffle(order)
        orders.append(order)
    # place[i] = position of feature i in the order
    places = [[o.index(i) for i in range(d)] for o in orders]
    lit = lambda seq: F.array(*[F.lit(v) for v in seq])
    probes = rows.select("_key", "_x", F.posexplode(F.array(*[lit(p) for p in places])).alias("_perm", "_place"))
    probes = probes.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    base = lit([float(v) for v in mean])
    mixed = F.transform("_x", lambda v, i: F.when(F.get("_place", i) < F.col("_step"), v).otherwise(F.get(base, i)))
    out = model.transform(probes.withColumn(vector, array_to_vector(mixed)))
    value = vector_to_array("probability").getItem(1) if "probability" in out.columns else F.col("prediction")
    out = out.select("_key", "_perm", "_step", "_place", value.alias("_value"))
    w = W.partitionBy("_key", "_perm").orderBy("_step")
    delta = out.withColumn("_delta", F.col("_value") - F.lag("_value").over(w)).where(F.col("_step") > 0)
    index = F.array_position("_place", F.col("_step") - 1) - 1
    names = lit(list(features))
    return delta.groupBy(F.col("_key").alias(key), F.get(names, index.cast("int")).alias("feature")).agg(F.avg("_delta").alias("attribution"))


def mean_attribution(values: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature, largest first."""
    return values.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance"), F.avg("attribution").alias("mean_attribution")).orderBy(
        F.desc("importance"), "feature")
