"""Exact neighbour joins over distinct points.

Pivots split the space into cells; the triangle inequality tells which points
can be near some query of a cell, so only those travel there. Cells are cut
into chunks of bounded size on both sides and each task returns a reduced
result of its chunk, never all pairs. Equal points are merged first with a
weight, so copies never multiply.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.operators.shared import pin_small

MAX_PIVOTS = 1024
QUERY_CHUNK = 20_000
POINT_CHUNK = 50_000
BLOCK_NUMBERS = 4_000_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))


def blocks(n: int, m: int, d: int) -> Iterator[slice]:
    step = max(1, BLOCK_NUMBERS // max(1, m * d))
    for start in range(0, n, step):
        yield slice(start, min(n, start + step))


def stack(series: pd.Series) -> np.ndarray:
    return np.vstack(series.to_numpy()).astype(float)


def objects(values) -> pd.Series:
    """Text and array columns as plain objects, also when they are empty."""
    return pd.Series(list(values), dtype=object)


def distinct_points(df: DataFrame, vec: str) -> DataFrame:
    """``vec, weight``: equal vectors merged."""
    return df.groupBy(F.col(vec).alias("vec")).agg(F.count(F.lit(1)).alias("weight"))


@dataclass
class Cells:
    """Pivots with the radius of each pivot's cell (pivots by dimensions in size)."""
    pivots: np.ndarray
    radius: np.ndarray
    between: np.ndarray

    def nearest(self) -> Callable[[str], Column]:
        p = self.pivots

        @F.pandas_udf("struct<cell:int,dist:double>")
        def udf(vecs: pd.Series) -> pd.DataFrame:
            x = stack(vecs)
            cell, dist = np.empty(len(x), dtype=np.int32), np.empty(len(x))
            for s in blocks(len(x), len(p), p.shape[1]):
                d = distances(x[s], p)
                cell[s], dist[s] = d.argmin(axis=1), d.min(axis=1)
            return pd.DataFrame({"cell": cell, "dist": dist})

        return udf

    def within_reach(self, reach: np.ndarray) -> Callable[[str], Column]:
        """Cells that may hold a query at most ``reach[cell]`` away from the point."""
        p, radius, between = self.pivots, self.radius, self.between
        limit = reach * (1 + 1e-9) + 1e-9

        @F.pandas_udf("array<int>")
        def udf(vecs: pd.Series) -> pd.Series:
            x, out = stack(vecs), []
            for s in blocks(len(x), len(p), p.shape[1]):
                d = distances(x[s], p)
                own, low = d.argmin(axis=1), d.min(axis=1)
                gap = between[own]
                # distance to the plane halfway between the two pivots
                plane = np.where(gap > 0, (d ** 2 - (low ** 2)[:, None]) / (2 * np.where(gap > 0, gap, 1.0)), 0.0)
                ok = (d - radius[None, :] <= limit[None, :]) & (plane <= limit[None, :])
                out.extend(np.flatnonzero(row).astype(np.int32) for row in ok)
            return pd.Series(out)

        return udf


def choose_pivots(points: DataFrame, count: int | None = None) -> np.ndarray:
    n = points.count()
    if n == 0:
        raise ValueError("no points")
    count = count or max(1, min(MAX_PIVOTS, int(math.sqrt(n) / 2)))
    rows = points.orderBy(F.xxhash64("vec"), "vec").select("vec").limit(count).collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def make_cells(points: DataFrame, count: int | None = None) -> Cells:
    p = choose_pivots(points, count)
    cells = Cells(p, np.zeros(len(p)), distances(p, p))
    far = points.select(cells.nearest()("vec").alias("_n")).groupBy("_n.cell").agg(F.max("_n.dist").alias("u"))
    for row in far.collect():
        cells.radius[row["cell"]] = row["u"]
    return cells


def cogroup_chunks(a: DataFrame, b: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
                   pairs: int | None = None) -> DataFrame:
    """``fn`` for the rows of both sides with the same keys.

    A pair of chunks is few bytes and much work: the number of tasks is fixed, as Spark merges others by their bytes.
    """
    spark = a.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(1, min(tasks, pairs or tasks))
    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(b.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(fn, schema)


def chunk_apply(cells: Cells, queries: DataFrame, points: DataFrame, reach: np.ndarray,
                fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn(query chunk, point chunk)`` for every chunk pair that can be within reach.

    Both frames have ``vec`` first; together the chunk pairs of a query hold
    every point within reach of it exactly once.
    """
    # new attribute names: both sides may come from the same frame
    points = points.toDF(*points.columns)
    q = queries.withColumn("_cell", cells.nearest()("vec").getField("cell"))
    s = points.withColumn("_cell", F.explode(cells.within_reach(reach)("vec")))
    size_q = q.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("_nq"))
    size_s = s.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / POINT_CHUNK).cast("int").alias("_ns"))
    sizes, rows = pin_small(size_q.join(size_s, "_cell"))
    part = lambda n: F.pmod(F.xxhash64("vec"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(sizes, "_cell").withColumn("_qc", part("_nq")).withColumn("_sc", every("_ns")).drop("_nq", "_ns")
    s = s.join(sizes, "_cell").withColumn("_sc", part("_ns")).withColumn("_qc", every("_nq")).drop("_nq", "_ns")
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: objects([]) for n in names})
        return fn(left, right)

    keys = ["_cell", "_qc", "_sc"]
    return cogroup_chunks(q, s, keys, run, schema, sum(r["_nq"] * r["_ns"] for r in rows))


def knn(points: DataFrame, k: int, queries: DataFrame | None = None, pivots: int | None = None) -> DataFrame:
    """``vec, neighbour, weight, distance, rank`` for every distinct query vector.

    ``points`` has ``vec array<double>`` and ``weight``; ``queries`` (default:
    all points) has ``vec`` and is a subset of the points. The point itself is
    listed with weight one less (its copies). Weights of a query sum to ``k``
    (or to all other rows when there are fewer).
    """
    queries = (points if queries is None else queries).select("vec").distinct()
    cells = make_cells(points, pivots)
    located = points.select("vec", cells.nearest()("vec").alias("_n")).select("vec", "_n.cell", "_n.dist")
    near = W.partitionBy("cell").orderBy("dist", "vec")
    close = located.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1).select("cell", "dist").collect()
    at, dist = np.array([r["cell"] for r in close]), np.array([r["dist"] for r in close])
    # every query of cell i has k + 1 points (itself included) within reach[i]
    reach = np.full(len(cells.pivots), np.inf)
    if len(close) > k:
        for i in range(len(reach)):
            reach[i] = np.partition(cells.between[i, at] + dist, k)[k] + cells.radius[i]

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, w = stack(left["vec"]), stack(right["vec"]), right["weight"].to_numpy()
        take = min(k + 1, len(b))
        rows: dict[str, list] = {"vec": [], "neighbour": [], "weight": [], "distance": []}
        for sl in blocks(len(a), len(b), a.shape[1]):
            x = a[sl]
            d = distances(x, b)
            edge = np.partition(d, take - 1, axis=1)[:, take - 1]
            for i in range(len(x)):
                cand = np.flatnonzero(d[i] <= edge[i])
                order = cand[np.lexsort((*b[cand].T[::-1], d[i, cand]))][:take]
                rows["vec"].extend([x[i]] * len(order))
                rows["neighbour"].extend(list(b[order]))
                rows["weight"].extend(w[order].tolist())
                rows["distance"].extend(d[i, order].tolist())
        return pd.DataFrame(rows)

    schema = "vec array<double>, neighbour array<double>, weight bigint, distance double"
    found = chunk_apply(cells, queries, points.select("vec", "weight"), reach, best, schema)
    own = F.col("neighbour") == F.col("vec")
    found = found.withColumn("weight", F.when(own, F.col("weight") - 1).otherwise(F.col("weight"))).where(F.col("weight") > 0)
    order = W.partitionBy("vec").orderBy("distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("_b", before).where(F.col("_b") < k).withColumn(
        "weight", F.least(F.col("weight"), F.lit(k) - F.col("_b"))).drop("_b")
