"""Global order without one global task: row numbers, n-tiles, running sums.

Rows are cut into score ranges by a quantile sketch; each range is ordered on
its own and shifted by the totals of the ranges before it. A score that holds
many rows is cut further by the hash of the row key, so that a third of all
rows with one score still spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.ml.feature import Bucketizer

from featurelens.functions.expressions import unit_hash
from featurelens.operators.shared import ensure_checkpoint_dir, join_groups, pin_small

MAX_PIECES = 20_000
SHIFT_ROWS = 1_000_000      # groups times pieces that the driver agrees to hold


def _score_ranges(df: DataFrame, order: str, rows_per_task: int) -> tuple[list[float], dict[float, int], int, int]:
    """Cut points for pieces of about ``rows_per_task`` rows, and the numbers of hash parts of hot scores, of NaN and of null."""
    value = F.col(order).cast("double")
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan(value)).alias("nan"), F.count_if(value.isNull()).alias("null")).first()
    n = seen["n"]
    nan, null = (math.ceil(seen[c] / rows_per_task) for c in ("nan", "null"))
    pieces = min(MAX_PIECES, math.ceil(n / rows_per_task)) if n else 1
    if pieces <= 1:
        return [], {}, nan, null
    step = 4
    points = step * pieces
    grid = [i / points for i in range(1, points)]
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.col(order))
    cuts = df.agg(F.percentile_approx(finite, grid, 5 * points).alias("q")).first()["q"] or []
    if not cuts:
        return [0.0], {}, nan, null
    repeats: dict[float, int] = {}
    for q in cuts:
        repeats[q] = repeats.get(q, 0) + 1
    picked = sorted({cuts[min(len(cuts) - 1, i * step)] for i in range(1, pieces)})
    # a value that spans several pieces is split by hash into as many parts
    hot = {q: math.ceil(c / step) for q, c in repeats.items() if c >= 2 * step}
    return sorted(set(picked) | set(hot)), hot, nan, null


def running_totals(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    seed: int = 12345,
    rows_per_task: int = 2_000_000,
) -> DataFrame:
    """Add inclusive running sums in the order ``order`` descending.

    Ties are ordered by the hash of the ``tie`` columns and then by the columns
    themselves. Without ``tie`` the order column must be unique within ``by``.
    NaN stands first and null last; a null group is a group.
    """
    by, tie = list(by), list(tie)
    src = df
    for name, expr in sums.items():
        src = src.withColumn(f"_in_{name}", expr)
    if tie:
        src = src.withColumn("_u", unit_hash(*tie, seed=seed))
    keys = [F.col(order).desc()] + ([F.col("_u").asc()] + [F.col(t).asc() for t in tie] if tie else [])

    cuts, hot, nan, null = _score_ranges(src, order, rows_per_task)
    if not cuts:
        upto = W.partitionBy(*by).orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
        out = src.select("*", *[F.sum(f"_in_{n}").over(upto).alias(n) for n in sums])
        return out.drop("_u", *[f"_in_{n}" for n in sums])

    # _part grows along the order: high score first, then hash parts of one hot score
    splits = [-math.inf, *cuts, math.inf]
    value = F.col(order).cast("double")
    src = Bucketizer(splits=splits, inputCol="_order", outputCol="_range", handleInvalid="keep").transform(src.withColumn("_order", value)).drop("_order")
    src = src.withColumn("_range", F.when(value.isNull(), -1).when(F.isnan(value), len(splits)).otherwise(F.col("_range")))
    width = 2 + max([nan, null, *hot.values()])
    part = F.lit(0)
    if hot and tie:
        parts = F.create_map(*[F.lit(x) for q, k in hot.items() for x in (float(q), int(k))])
        slices = F.try_element_at(parts, F.col(order).cast("double"))
        part = F.when(slices.isNotNull(), 1 + F.floor(F.col("_u") * slices)).otherwise(0)
    if tie:
        for there, k in ((value.isNull(), null), (F.isnan(value), nan)):
            part = F.when(there, F.floor(F.col("_u") * max(k, 1))).otherwise(part)
    src = src.withColumn("_part", ((len(splits) - F.col("_range")) * width + part).cast("bigint"))

    totals = src.groupBy(*by, "_part").agg(*[F.sum(f"_in_{n}").alias(n) for n in sums])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift, _ = pin_small(totals.select(
        *by, "_part", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_shift_{n}") for n in sums]), SHIFT_ROWS)
    inner = W.partitionBy(*by, "_part").orderBy(*keys).rowsBetween(W.unboundedPreceding, 0)
    ordered = src.select("*", *[F.sum(f"_in_{n}").over(inner).alias(f"_run_{n}") for n in sums])
    joined = join_groups(ordered, shift, [*by, "_part"])
    for n in sums:
        joined = joined.withColumn(n, F.col(f"_run_{n}") + F.col(f"_shift_{n}"))
    return joined.drop("_part", "_range", "_u", *[f"{x}{n}" for n in sums for x in ("_in_", "_run_", "_shift_")])


def row_numbers(df: DataFrame, order: str, tie: Sequence[str], by: Sequence[str] = (), **kw) -> DataFrame:
    """``row_number`` by ``order`` descending, ties by the key hash."""
    return running_totals(df, order, {"row_number": F.lit(1).cast("bigint")}, by=by, tie=tie, **kw)


def ntiles(df: DataFrame, order: str, tie: Sequence[str], by: Sequence[str] = (), n: int = 10, **kw) -> DataFrame:
    """``decile`` column equal to SQL ``ntile(n)`` over the same order."""
    by = list(by)
    numbered = row_numbers(df, order, tie, by, **kw)
    if by:
        sizes, _ = pin_small(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
        numbered = join_groups(numbered, sizes, by)
    else:
        numbered = numbered.withColumn("_n", F.lit(df.count()))
    small, extra = F.floor(F.col("_n") / n), F.col("_n") % n
    edge = extra * (small + 1)
    r = F.col("row_number") - 1
    tile = F.when(r < edge, F.floor(r / (small + 1))).otherwise(extra + F.floor((r - edge) / F.greatest(small, F.lit(1))))
    return numbered.withColumn("decile", (tile + 1).cast("int")).drop("_n")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with the place of each row, from 0, in the ascending order of a unique column of any type.

    Rows are dealt by range, numbered in each range and shifted by the rows of the ranges before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    placed = df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).checkpoint()
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_place", place).join(before, "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def approximate_ntiles(df: DataFrame, order: str, n: int = 10, accuracy: int = 10_000) -> DataFrame:
    """W2 at any size: cut points from a sketch, no ordering of the rows."""
    from featurelens.functions.expressions import bucket_tree
    cuts = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], accuracy).alias("q")).first()["q"]
    return df.withColumn("decile", F.lit(n) - bucket_tree(F.col(order), cuts or []))


def cumulative_by_step(df: DataFrame, step: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Running totals over a short aggregated table (one row per step)."""
    upto = W.partitionBy(*by).orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    return df.select("*", *[F.sum(v).over(upto).alias(f"cum_{v}") for v in values])
