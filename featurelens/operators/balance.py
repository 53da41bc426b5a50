"""Class balancing: replication and synthetic rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featurelens.functions.expressions import as_double, field_type, unit_hash
from featurelens.operators.neighbours import distinct_points, knn
from featurelens.operators.ordering import numbered
from featurelens.operators.shared import ensure_checkpoint_dir, pin_small


def class_needs(df: DataFrame, target: str, max_ratio: float = 0.05, base_rows: int | None = None) -> DataFrame:
    """Rows to add per class: up to ``int(majority * max_ratio)`` (or of ``base_rows``),
    for classes under that count and under that share."""
    counts, rows = pin_small(df.groupBy(target).agg(F.count(F.lit(1)).alias("_count")))
    total, most = sum(r["_count"] for r in rows), max((r["_count"] for r in rows), default=0)
    goal = int((base_rows if base_rows is not None else most) * max_ratio)
    lacks = (F.col("_count") / F.lit(total) < max_ratio) & (F.col("_count") < goal)
    return counts.withColumn("_need", F.when(lacks, F.lit(goal) - F.col("_count")).otherwise(F.lit(0)))


def _times(expected, *keys: str, seed: int):
    """Whole part plus one more with the probability of the fraction."""
    return (F.floor(expected) + F.when(unit_hash(*keys, seed=seed) < expected - F.floor(expected), 1).otherwise(0)).cast("int")


def _exact_times(df: DataFrame, expected: Column, need: int, key: str, seed: int) -> DataFrame:
    """``df`` with ``_times``, near ``expected`` for each row and ``need`` in sum.

    Every row gets the whole part; the rest goes to rows drawn without replacement, with the fractions as weights:
    those with the smallest exponential waiting time, found by a global order without a global task.
    """
    whole = df.withColumn("_whole", F.floor(expected).cast("int")).withColumn("_part", expected - F.floor(expected)).checkpoint()
    rest = need - whole.agg(F.sum("_whole")).first()[0]
    wait = F.when(F.col("_part") > 0, -F.ln(1.0 - unit_hash(key, seed=seed)) / F.col("_part")).otherwise(float("inf"))
    placed = numbered(whole.withColumn("_order", F.struct(wait.alias("wait"), F.col(key).alias("key"))), "_order", "_at")
    return placed.withColumn("_times", F.col("_whole") + (F.col("_at") < rest).cast("int")).drop("_whole", "_part", "_order", "_at")


def oversample(df: DataFrame, target: str, key: str, max_ratio: float = 0.05, seed: int = 12345) -> DataFrame:
    """Rows of small classes are repeated; ``copy`` is 0 for the original row.

    One pass without a shuffle of the rows: each row makes its own copies.
    """
    needs = class_needs(df, target, max_ratio)
    joined = df.join(needs, target, "left")
    extra = _times(F.col("_need") / F.col("_count"), key, seed=seed)
    copies = F.sequence(F.lit(0), F.coalesce(extra, F.lit(0)))
    return joined.withColumn("copy", F.explode(copies)).drop("_need", "_count").select(*df.columns, "copy")


def smote(
    df: DataFrame, target: str, key: str, features: Sequence[str], max_ratio: float = 0.05, k: int = 5, seed: int = 12345,
    base_rows: int | None = None, pivots: int | None = None,
) -> DataFrame:
    """Synthetic rows between a row and one of its ``k`` nearest rows of the same class.

    A base row is drawn with a weight that falls with its mean z-distance from
    the class centre. A class with fewer than ``k`` rows, or one row, is replicated
    instead. A missing feature counts as the mean of its class (0 if all miss it).
    Each class gets exactly the rows it needs. The result has ``target``, the
    features and ``synthetic``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    features = list(features)
    needs, rows = pin_small(class_needs(df, target, max_ratio, base_rows))
    base = df.select(target, key, *features, F.lit(False).alias("synthetic"))
    parts = [base.drop(key)]
    ints = {f for f in features if isinstance(field_type(df, f), T.IntegralType)}

    def typed(c, f: str):
        return (F.round(c) if f in ints else c).cast(field_type(df, f)).alias(f)

    for row in rows:
        need, count = row["_need"], row["_count"]
        if need <= 0:
            continue
        raw = df.where(F.col(target) == F.lit(row[target])).select(
            F.col(key).alias("_key"), F.array(*[as_double(f, field_type(df, f)) for f in features]).alias("vec"))
        centre = raw.agg(*[x for i in range(len(features)) for x in (
            F.avg(F.col("vec").getItem(i)).alias(f"m{i}"), F.stddev_pop(F.col("vec").getItem(i)).alias(f"s{i}"))]).first()
        mean = [centre[f"m{i}"] or 0.0 for i in range(len(features))]
        spread = [centre[f"s{i}"] or 0.0 for i in range(len(features))]
        members = raw.select("_key", F.array(*[F.coalesce(F.get("vec", F.lit(i)), F.lit(mean[i])) for i in range(len(features))]).alias("vec"))
        if count < max(k, 2):
            extra = _exact_times(members, F.lit(need / count), need, "_key", seed).where(F.col("_times") > 0)
            extra = extra.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times"))))
            made = extra.select(F.lit(row[target]).alias(target), *[typed(F.col("vec").getItem(i), f) for i, f in enumerate(features)],
                                F.lit(True).alias("synthetic"))
            parts.append(made)
            continue
        if any(s > 0 for s in spread):
            z = sum(F.abs(F.col("vec").getItem(i) - F.lit(mean[i])) / F.lit(spread[i] + 1e-8) for i in range(len(features)))
            weight = 1.0 / (1.0 + z / len(features))
        else:
            weight = F.lit(1.0)
        weighted = members.withColumn("_w", weight)
        total = weighted.agg(F.sum("_w")).first()[0]
        drawn = _exact_times(weighted, F.col("_w") / F.lit(total) * need, need, "_key", seed).where(F.col("_times") > 0)
        draws = drawn.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_key", "vec", "_n")
        pairs = knn(distinct_points(members, "vec"), k, drawn.select("vec"), pivots)
        # at most k neighbours per distinct vector
        lists = pairs.groupBy("vec").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "weight"))).alias("_near"))
        flat = F.flatten(F.transform("_near", lambda x: F.array_repeat(x["neighbour"], x["weight"].cast("int"))))
        joined = draws.join(lists.withColumn("_near", flat), "vec")
        pick = F.floor(unit_hash("_key", "_n", seed=seed + 1) * F.size("_near")).cast("int")
        alpha = unit_hash("_key", "_n", seed=seed + 2)
        joined = joined.withColumn("_other", F.get("_near", pick)).withColumn("_alpha", alpha)
        point = F.zip_with("vec", "_other", lambda a, b: a + F.col("_alpha") * (b - a))
        made = joined.withColumn("_point", point).select(
            F.lit(row[target]).alias(target), *[typed(F.col("_point").getItem(i), f) for i, f in enumerate(features)],
            F.lit(True).alias("synthetic"))
        parts.append(made)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
