"""Density clustering, exact for any number of dimensions.

Cells of side ``eps / sqrt(d)`` decide most rows without a distance: a cell
with ``min_pts`` rows is all core and all connected. Distances are computed
for the rows of sparse cells and for a few representatives of dense cells;
only dense cells that stay apart after that, with boxes within ``eps``, are
compared in full.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from featurelens.functions.expressions import as_double, field_type
from featurelens.operators.components import connected_components
from featurelens.operators.joins import salted_join, spread_join
from featurelens.operators.neighbours import (
    POINT_CHUNK, QUERY_CHUNK, blocks, chunk_apply, cogroup_chunks, distances, make_cells, stack, objects,
)
from featurelens.operators.ordering import numbered
from featurelens.operators.shared import ensure_checkpoint_dir

NOISE = -1
REPRESENTATIVES = 16

# Default parameter grid, and the conservative second grid.
EPS_GRID = [0.1, 0.3, 0.5, 0.7, 1.0]
MIN_PTS_GRID = [3, 5, 7, 10]
CONSERVATIVE_EPS = [0.05, 0.1, 0.15, 0.2]
CONSERVATIVE_MIN_PTS = [2, 3]
MAX_NOISE_PERCENT = 80.0


def cell_node(column):
    return F.md5(F.to_json(F.struct(column)).cast("binary"))


def spanning_forest(u: np.ndarray, v: np.ndarray, level: np.ndarray, levels: int) -> np.ndarray:
    """Indices of edges that connect, up to every level, what all edges up to that level connect, without a cycle."""
    n = int(max(u.max(), v.max())) + 1 if len(u) else 0
    root, kept = np.arange(n), [np.empty(0, dtype=np.int64)]
    for lv in range(levels):
        at = np.flatnonzero(level == lv)
        while len(at):
            a, b = root[u[at]], root[v[at]]
            at, a, b = at[a != b], a[a != b], b[a != b]
            high, low = np.maximum(a, b), np.minimum(a, b)
            # every tree that touches one with a smaller root joins the smallest
            least = np.full(n, n)
            np.minimum.at(least, high, low)
            chosen = np.full(n, -1)
            hit = low == least[high]
            chosen[high[hit]] = at[hit]
            trees = np.flatnonzero(chosen >= 0)
            kept.append(chosen[trees])
            root[trees] = least[trees]
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept)


def fit_dbscan(df: DataFrame, key: str, features: Sequence[str], eps: float, min_pts: int, pivots: int | None = None) -> DataFrame:
    """``key, prediction, core``; noise is -1, as are rows with a missing feature, clusters are numbered from 0 by their smallest core key.

    A border row joins the cluster with the smallest number among its core neighbours.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    d = len(features)
    side = eps / math.sqrt(d) * (1 - 1e-9)     # the diagonal stays under eps
    vec = F.array(*[as_double(f, field_type(df, f)) for f in features])
    every = df.select(F.col(key).alias("_key"), vec.alias("vec"))
    gap = F.exists("vec", lambda x: x.isNull())
    rows = every.where(~gap)
    pts = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min("_key").alias("first"))
    pts = pts.withColumn("cell", F.transform("vec", lambda x: F.floor(x / side))).withColumn("cell", cell_node(F.col("cell")))
    sizes = pts.groupBy("cell").agg(F.sum("weight").alias("held"))
    dense = sizes.where(F.col("held") >= min_pts).select("cell", F.lit(True).alias("dense"))
    pts = salted_join(pts, dense, ["cell"], "left", salt_by=["vec"], spread=True).withColumn("dense", F.coalesce("dense", F.lit(False))).checkpoint()

    cells = make_cells(pts, pivots)
    reach = np.full(len(cells.pivots), float(eps))

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, w = stack(left["vec"]), stack(right["vec"]), right["weight"].to_numpy()
        total = np.concatenate([(distances(a[s], b) <= eps) @ w for s in blocks(len(a), len(b), d)])
        return pd.DataFrame({"vec": objects(a), "n": total.astype("int64")})

    sparse = pts.where(~F.col("dense")).select("vec")
    counted = chunk_apply(cells, sparse, pts.select("vec", "weight"), reach, count, "vec array<double>, n bigint")
    counted = counted.groupBy("vec").agg(F.sum("n").alias("n")).where(F.col("n") >= min_pts)
    pts = spread_join(pts, counted, ["vec"], "left").select(
        "vec", "weight", "first", "cell", "dense", (F.col("dense") | F.col("n").isNotNull()).alias("core"))
    # a dense cell is one node, any other core point is a node of its own
    pts = pts.withColumn("node", F.when(F.col("dense"), F.col("cell")).otherwise(cell_node(F.col("vec")))).checkpoint()
    core = pts.where("core")

    heads = heads_of_cells(core.where("dense"), d)
    asking = core.where(~F.col("dense")).select("vec", "node").unionByName(heads.select("vec", "node"))

    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = stack(left["vec"]), stack(right["vec"])
        codes, names = pd.factorize(pd.concat([left["node"], right["node"]]))
        ca, cb = codes[:len(a)], codes[len(a):]
        u = v = np.empty(0, dtype=np.int64)
        for s in blocks(len(a), len(b), d):
            i, j = np.nonzero((distances(a[s], b) <= eps) & (ca[s][:, None] != cb[None]))
            u, v = np.concatenate([u, ca[s][i]]), np.concatenate([v, cb[j]])
            # only a forest is held, never all links
            kept = spanning_forest(u, v, np.zeros(len(u), dtype=np.int64), 1)
            u, v = u[kept], v[kept]
        return pd.DataFrame({"u": objects(names[u]), "v": objects(names[v])})

    edges = chunk_apply(cells, asking, core.select("vec", "node"), reach, link, "u string, v string").distinct()
    nodes = core.select("node").distinct()
    comp = connected_components(nodes, edges, spread=True).checkpoint()
    comp = _join_separate_cells(core, comp, nodes, edges, d, eps).checkpoint()

    named = salted_join(core, comp, ["node"], "inner", salt_by=["vec"], spread=True)
    order = named.groupBy("component").agg(F.min("first").alias("first"))
    order = numbered(order, "first", "prediction").select("component", F.col("prediction").cast("int").alias("prediction"))
    core_labels = salted_join(named, order, ["component"], "inner", salt_by=["vec"], spread=True).select("vec", "prediction").checkpoint()

    def border(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, label = stack(left["vec"]), stack(right["vec"]), right["prediction"].to_numpy()
        best = np.concatenate([np.where(distances(a[s], b) <= eps, label[None, :], np.iinfo("int32").max).min(axis=1)
                               for s in blocks(len(a), len(b), d)])
        hit = best < np.iinfo("int32").max
        return pd.DataFrame({"vec": objects(v for v, h in zip(a, hit) if h), "prediction": best[hit].astype("int32")})

    edge_rows = pts.where(~F.col("core")).select("vec")
    near = chunk_apply(cells, edge_rows, core_labels, reach, border, "vec array<double>, prediction int")
    near = near.groupBy("vec").agg(F.min("prediction").alias("prediction"))
    labels = core_labels.withColumn("core", F.lit(True)).unionByName(near.withColumn("core", F.lit(False)))
    out = salted_join(rows, labels, ["vec"], "left", salt_by=["_key"], spread=True)
    out = out.select("_key", "prediction", "core").unionByName(every.where(gap).select("_key"), allowMissingColumns=True)
    return out.select(F.col("_key").alias(key), F.coalesce("prediction", F.lit(NOISE)).alias("prediction"),
                      F.coalesce("core", F.lit(False)).alias("core"))


def heads_of_cells(dense: DataFrame, d: int) -> DataFrame:
    """``node, vec``: a few extreme points of every dense cell."""
    extremes = [agg("vec", F.struct(F.get("vec", F.lit(i)), "vec")).alias(f"e{i}{s}")
                for i in range(min(d, REPRESENTATIVES // 2)) for agg, s in ((F.min_by, "a"), (F.max_by, "b"))]
    heads = dense.groupBy("node").agg(*extremes)
    return heads.select("node", F.explode(F.array_distinct(F.array(*[c for c in heads.columns if c != "node"]))).alias("vec"))


def compare_cells(own: DataFrame, boxes: DataFrame, pairs: DataFrame, limit: float,
                  fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` on chunks of the rows of both cells of each pair that are within ``limit`` of the other cell's box."""
    box = boxes.select("node", "lo", "hi")
    sides = spread_join(pairs, box.withColumnsRenamed({"node": "u", "lo": "ulo", "hi": "uhi"}), ["u"])
    sides = spread_join(sides, box.withColumnsRenamed({"node": "v", "lo": "vlo", "hi": "vhi"}), ["v"])

    def gap(lo: str, hi: str):
        return F.sqrt(F.aggregate(F.zip_with("vec", F.arrays_zip(lo, hi), lambda x, b: F.pow(
            F.greatest(b[lo] - x, x - b[hi], F.lit(0.0)), 2)), F.lit(0.0), lambda a, x: a + x))

    # only rows within reach of the other box can make the link
    a = salted_join(own.withColumnRenamed("node", "u"), sides.select("u", "v", "vlo", "vhi"), ["u"], salt_by=["vec"], spread=True).where(
        gap("vlo", "vhi") <= limit).select("u", "v", "vec")
    # new attribute names, as both sides come from the same frames
    b = salted_join(own.toDF("node", "vec").withColumnRenamed("node", "v"), sides.toDF(*sides.columns).select("u", "v", "ulo", "uhi"), ["v"], salt_by=["vec"], spread=True).where(
        gap("ulo", "uhi") <= limit).select("u", "v", "vec")
    na = a.groupBy("u", "v").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("_nq"))
    nb = b.groupBy("u", "v").agg(F.ceil(F.count(F.lit(1)) / POINT_CHUNK).cast("int").alias("_ns"))
    counts = spread_join(na, nb, ["u", "v"])
    a = spread_join(a, counts, ["u", "v"]).withColumn("_qc", F.pmod(F.xxhash64("vec"), F.col("_nq"))).withColumn(
        "_sc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ns") - F.lit(1).cast("bigint"))))
    b = spread_join(b, counts.toDF(*counts.columns), ["u", "v"]).withColumn("_sc", F.pmod(F.xxhash64("vec"), F.col("_ns"))).withColumn(
        "_qc", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nq") - F.lit(1).cast("bigint"))))
    keys = ["u", "v", "_qc", "_sc"]
    return cogroup_chunks(a, b, keys, fn, schema)


def _join_separate_cells(core: DataFrame, comp: DataFrame, nodes: DataFrame, edges: DataFrame, d: int, eps: float) -> DataFrame:
    """Full comparison of dense cells in different components whose boxes are within ``eps``."""
    dims = range(d)
    boxes = core.where("dense").groupBy("node").agg(
        F.array(*[F.min(F.get("vec", F.lit(i))) for i in dims]).alias("lo"),
        F.array(*[F.max(F.get("vec", F.lit(i))) for i in dims]).alias("hi"), F.count(F.lit(1)).alias("n"))
    boxes = spread_join(boxes, comp, ["node"]).select(
        F.zip_with("lo", "hi", lambda a, b: (a + b) / 2).alias("vec"), "node", "component", "lo", "hi", "n").checkpoint()
    if boxes.select("component").distinct().limit(2).count() < 2:
        return comp
    cells = make_cells(boxes)

    def close(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        la, ha, lb, hb = (stack(c) for c in (left["lo"], left["hi"], right["lo"], right["hi"]))
        ca, cb = left["component"].to_numpy(), right["component"].to_numpy()
        na, nb = left["node"].to_numpy(), right["node"].to_numpy()
        u, v = [], []
        for s in blocks(len(la), len(lb), d):
            gap = np.maximum(0.0, np.maximum(lb[None] - ha[s][:, None], la[s][:, None] - hb[None]))
            i, j = np.nonzero((np.sqrt((gap ** 2).sum(axis=2)) <= eps) & (ca[s][:, None] < cb[None]))
            u.extend(na[s][i])
            v.extend(nb[j])
        return pd.DataFrame({"u": objects(u), "v": objects(v)})

    # centres of two such boxes are at most eps plus two half diagonals apart
    reach = np.full(len(cells.pivots), 2.0 * eps)
    pairs = chunk_apply(cells, boxes, boxes, reach, close, "u string, v string").checkpoint()
    if pairs.isEmpty():
        return comp

    def touch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not left.empty and not right.empty:
            x, y = stack(left["vec"]), stack(right["vec"])
            for s in blocks(len(x), len(y), d):
                if (distances(x[s], y) <= eps).any():
                    return pd.DataFrame({"u": objects([left["u"].iloc[0]]), "v": objects([left["v"].iloc[0]])})
        return pd.DataFrame({"u": objects([]), "v": objects([])})

    more = compare_cells(core.where("dense").select("node", "vec"), boxes, pairs, eps, touch, "u string, v string").distinct()
    lifted = spread_join(spread_join(more, comp.withColumnsRenamed({"node": "u", "component": "cu"}), ["u"]),
                         comp.withColumnsRenamed({"node": "v", "component": "cv"}), ["v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    groups = connected_components(comp.select(F.col("component").alias("node")).distinct(), lifted, spread=True)
    return spread_join(comp, groups.select(F.col("node").alias("component"), F.col("component").alias("whole")), ["component"]).select(
        "node", F.col("whole").alias("component"))


def nearest_core_labels(points: DataFrame, cores: DataFrame, eps: float) -> DataFrame:
    """``vec, prediction`` for the points with a core row within ``eps``: the label of the nearest, ties to the smallest."""
    cells = make_cells(cores)
    # queries may lie outside the cells of the core rows
    far = points.select(cells.nearest()("vec").alias("_n")).groupBy("_n.cell").agg(F.max("_n.dist").alias("u")).collect()
    for r in far:
        cells.radius[r["cell"]] = max(cells.radius[r["cell"]], r["u"])

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, label = stack(left["vec"]), stack(right["vec"]), right["prediction"].to_numpy()
        low, pick = [], []
        for s in blocks(len(a), len(b), a.shape[1]):
            dist = distances(a[s], b)
            low.append(dist.min(axis=1))
            pick.append(np.where(dist <= low[-1][:, None], label[None, :], np.iinfo("int32").max).min(axis=1))
        low, pick = np.concatenate(low), np.concatenate(pick)
        ok = low <= eps
        return pd.DataFrame({"vec": objects(v for v, h in zip(a, ok) if h), "distance": low[ok], "prediction": pick[ok].astype("int32")})

    found = chunk_apply(cells, points, cores, np.full(len(cells.pivots), float(eps)), nearest,
                        "vec array<double>, distance double, prediction int")
    return found.groupBy("vec").agg(F.min_by("prediction", F.struct("distance", "prediction")).alias("prediction"))


def assign_dbscan(new: DataFrame, key: str, features: Sequence[str], fitted: DataFrame, train: DataFrame, eps: float) -> DataFrame:
    """New rows take the label of the nearest core row within ``eps``, else noise; all are noise if there is no core row."""
    def vectors(df: DataFrame) -> DataFrame:
        return df.withColumn("vec", F.array(*[as_double(f, field_type(df, f)) for f in features]))

    cores = spread_join(vectors(train), fitted.where("core"), [key]).groupBy("vec").agg(F.min("prediction").alias("prediction"))
    asked = vectors(new).select(F.col(key).alias("_key"), "vec")
    if cores.isEmpty():
        return asked.select(F.col("_key").alias(key), F.lit(NOISE).alias("prediction"))
    best = nearest_core_labels(asked.select("vec").distinct(), cores, eps)
    out = salted_join(asked, best, ["vec"], "left", salt_by=["_key"], spread=True)
    return out.select(F.col("_key").alias(key), F.coalesce("prediction", F.lit(NOISE)).alias("prediction"))
