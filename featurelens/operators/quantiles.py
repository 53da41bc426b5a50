"""Exact quantiles per group without gathering a group in one task.

Groups with few distinct values are counted value by value. In the others a
sketch gives bounds around the wanted ranks. The bounds cut the values into
cells, a row belongs to one cell, and exact counts of the cells tell where a
rank lies. Only the values of those cells are counted and ordered; one that
holds too many distinct values is cut again. So the last ordering step is
bounded, and the rows are never shuffled before they are counted.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from featurelens.operators.shared import join_groups, local_frame, pin_small

SKETCH_ACCURACY = 10_000
GRID = [i / 200 for i in range(201)]
DIRECT = 0          # cell of the groups that need no bounds


def exact_quantiles(
    long: DataFrame,
    group: Sequence[str],
    value: str,
    probs: Sequence[float],
    ordered_rows: int = 1_000_000,
    sizes: dict[tuple, tuple[int, int]] | None = None,
) -> DataFrame:
    """Rows ``(*group, p, q, n)``: linear-interpolation quantiles of ``value``.

    Nulls are ignored; ``value`` must hold no NaN. Groups are few (features,
    datasets, clusters): they are named by the schema, not by the rows.
    ``ordered_rows`` bounds the distinct values one task orders. ``sizes`` gives
    the count and the approximate distinct count per group when they are known.
    """
    spark, group = long.sparkSession, list(group)
    src = long.select(*group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    fields = [T.StructField(c, long.schema[c].dataType) for c in group]

    def frame(rows: list, *columns: tuple[str, T.DataType]) -> DataFrame:
        return local_frame(spark, rows, T.StructType(fields + [T.StructField(n, t) for n, t in columns]))

    if sizes is None:
        _, rows = pin_small(src.groupBy(*group).agg(F.count("_v").alias("n"), F.approx_count_distinct("_v").alias("d")))
        sizes = {tuple(r[c] for c in group): (r["n"], r["d"]) for r in rows}
    counts = {g: n for g, (n, _) in sizes.items() if n > 0}
    large = {g for g, n in counts.items() if min(n, 1.2 * sizes[g][1]) > ordered_rows}

    targets = []
    ranks: dict[tuple, list[tuple[float, int, int, float]]] = {}
    for g, n in counts.items():
        for p in probs:
            rank = p * (n - 1)
            low = round(rank) if abs(rank - round(rank)) < 1e-9 else math.floor(rank)
            ranks.setdefault(g, []).append((float(p), int(low), int(min(low + 1, n - 1)), max(0.0, rank - low)))

    counted = []
    if len(large) < len(counts):
        few = src if not large else _among(src, frame([g for g in counts if g not in large]), group)
        counted.append(few.groupBy(*group, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_cell", F.lit(DIRECT)))
        targets += [(*g, DIRECT, p, counts[g], a, b, f) for g in counts if g not in large for p, a, b, f in ranks[g]]
    if large:
        cells, found = _cells(_among(src, frame(list(large)), group), group, probs, ranks, counts, large, frame, ordered_rows)
        held = frame(sorted({(*g, c) for g, _, c, *_ in found}, key=str), ("_cell", T.IntegerType()))
        counted.append(_among(cells, held, [*group, "_cell"]).groupBy(*group, "_v", "_cell").agg(F.count(F.lit(1)).alias("_c")))
        targets += [(*g, c, p, counts[g], a, b, f) for g, p, c, a, b, f in found]

    wanted = frame(targets, ("_cell", T.IntegerType()), ("p", T.DoubleType()), ("n", T.LongType()), ("_r1", T.LongType()),
                   ("_r2", T.LongType()), ("_f", T.DoubleType()))
    if not counted:
        return wanted.select(*group, "p", F.lit(None).cast("double").alias("q"), "n")
    table = counted[0] if len(counted) == 1 else counted[0].unionByName(counted[1])
    upto = W.partitionBy(*group, "_cell").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = table.withColumn("_cum", F.sum("_c").over(upto))

    def covers(rank: str):
        return (F.col(rank) >= F.col("_cum") - F.col("_c")) & (F.col(rank) < F.col("_cum"))

    hit = join_groups(ranked, wanted, [*group, "_cell"]).where(covers("_r1") | covers("_r2"))
    a, b = F.max(F.when(covers("_r1"), F.col("_v"))), F.max(F.when(covers("_r2"), F.col("_v")))
    return hit.groupBy(*group, "p", "n", "_f").agg((a + (b - a) * F.col("_f")).alias("q")).select(*group, "p", "q", "n")


def _among(src: DataFrame, groups: DataFrame, group: list[str]) -> DataFrame:
    return join_groups(src, groups, group, "left_semi") if group else src


def _cells(many: DataFrame, group: list[str], probs: Sequence[float], ranks: dict, counts: dict, large: set, frame, ordered_rows: int):
    """Rows with their ``_cell``, and ``(group, p, cell, low rank, high rank, weight)`` with ranks from the cell's start.

    A rank that lies in another cell is -1; each wanted cell is one value or has at most ``ordered_rows`` distinct ones.
    """
    # the error of the sketch, and one rank on either side
    margin = 3 / SKETCH_ACCURACY + 2 / min(counts[g] for g in large)
    asks = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    _, rows = pin_small(many.groupBy(*group).agg(F.percentile_approx("_v", asks, SKETCH_ACCURACY).alias("b")))
    bounds = {tuple(r[c] for c in group): set(r["b"]) for r in rows}
    while True:
        cells = _located(many, bounds, group, frame)
        _, rows = pin_small(cells.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_v").alias("d")))
        sizes: dict[tuple, dict[int, tuple[int, int]]] = {}
        for r in rows:
            sizes.setdefault(tuple(r[c] for c in group), {})[r["_cell"]] = (r["n"], r["d"])
        found, wide = [], {}
        for g, of in sizes.items():
            order = sorted(of)
            ends = list(accumulate(of[c][0] for c in order))
            for p, a, b, f in ranks[g]:
                at = [bisect_right(ends, rank) for rank in (a, b)]
                low, high = (rank - (ends[i] - of[order[i]][0]) for rank, i in zip((a, b), at))
                if at[0] == at[1]:
                    found.append((g, p, order[at[0]], low, high, f))
                else:
                    found += [(g, p, order[at[0]], low, -1, f), (g, p, order[at[1]], -1, high, f)]
                for i, rank in zip(at, (low, high)):
                    n, d = of[order[i]]
                    if order[i] % 2 == 0 and 1.2 * d > ordered_rows:
                        wide.setdefault((*g, order[i]), set()).add(rank / n)
        if not wide:
            return cells, found
        inside = _among(cells, frame(list(wide), ("_cell", T.IntegerType())), [*group, "_cell"])
        _, rows = pin_small(inside.groupBy(*group, "_cell").agg(F.percentile_approx("_v", GRID, SKETCH_ACCURACY).alias("grid")))
        for r in rows:
            g, last = tuple(r[c] for c in group), len(GRID) - 1
            for share in wide[(*g, r["_cell"])]:
                bounds[g] |= {r["grid"][max(0, math.floor(share * last) - 1)], r["grid"][min(last, math.ceil(share * last) + 1)]}


def _located(many: DataFrame, bounds: dict, group: list[str], frame) -> DataFrame:
    """Each value's cell: even between two bounds, odd on one. A binary search, so every row stays one row."""
    if group:
        table = frame([(*g, sorted(b)) for g, b in bounds.items()], ("_bounds", T.ArrayType(T.DoubleType())))
        many, edges = join_groups(many, table, group), F.col("_bounds")
    else:
        edges = F.lit(sorted(bounds[()]))
    steps = [1 << i for i in reversed(range(max(map(len, bounds.values())).bit_length()))]
    below = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) <= F.col("_v"), at + step).otherwise(at))
    many = many.withColumn("_at", below)
    cell = 2 * F.col("_at") - F.coalesce((F.get(edges, F.col("_at") - 1) == F.col("_v")).cast("int"), F.lit(0))
    return many.select(*group, "_v", cell.cast("int").alias("_cell"))


def quantile_columns(quantiles: DataFrame, group: Sequence[str], names: dict[float, str]) -> DataFrame:
    """One row per group with one column per asked probability."""
    return quantiles.groupBy(*group).agg(
        *[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("q"))).alias(name) for p, name in names.items()])
