"""M14 over a grid of settings: every eps and min_pts from one pass over the neighbours.

A point is core at the first eps of the grid that brings it enough neighbours,
and two core points meet at the first eps that also spans their distance. Each
task reduces its pairs to a forest that connects, up to every eps, what its
pairs connect; the components of all settings are then read from these forests.
Cells that are dense at the smallest eps for the largest min_pts are single
nodes, as in ``dbscan``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from featurelens.functions.expressions import as_double, field_type
from featurelens.operators.cluster_metrics import feature_array, silhouette
from featurelens.operators.components import connected_components
from featurelens.operators.dbscan import (
    CONSERVATIVE_EPS, CONSERVATIVE_MIN_PTS, EPS_GRID, MAX_NOISE_PERCENT, MIN_PTS_GRID, NOISE,
    cell_node, compare_cells, fit_dbscan, heads_of_cells, nearest_core_labels, spanning_forest,
)
from featurelens.operators.joins import salted_join, spread_join
from featurelens.operators.neighbours import blocks, chunk_apply, distances, make_cells, objects, stack
from featurelens.operators.ordering import numbered
from featurelens.operators.shared import SMALL_FRAME_ROWS, ensure_checkpoint_dir, local_frame

NO_LABEL = np.iinfo("int32").max


def _grid_labels(df: DataFrame, key: str, features: Sequence[str], eps: list[float], min_pts: list[int], pivots: int | None) -> DataFrame:
    """``_key, vec, labels, cores``: one array place per setting, the places of one min_pts side by side."""
    if not eps or not min_pts or eps[0] <= 0:
        raise ValueError("a grid needs min_pts and positive eps")
    ensure_checkpoint_dir(df.sparkSession)
    d, n_eps, n_min = len(features), len(eps), len(min_pts)
    settings = n_eps * n_min
    steps = np.array(eps)
    side = eps[0] / math.sqrt(d) * (1 - 1e-9)
    vec = F.array(*[as_double(f, field_type(df, f)) for f in features])
    every = df.select(F.col(key).alias("_key"), vec.alias("vec"))
    gap = F.exists("vec", lambda x: x.isNull())
    rows = every.where(~gap)
    places = F.sequence(F.lit(0), F.lit(settings - 1))
    setting_eps = lambda s: F.pmod(s, F.lit(n_eps))
    level_of = lambda s: F.get("lev", F.floor(s / n_eps).cast("int"))
    is_core = lambda s: level_of(s) <= setting_eps(s)
    tagged = lambda s, node: F.concat_ws(":", s, node)

    pts = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("weight"), F.min("_key").alias("first"))
    pts = pts.withColumn("node", cell_node(F.transform("vec", lambda x: F.floor(x / side))))
    dense = pts.groupBy("node").agg(F.sum("weight").alias("held")).where(F.col("held") >= min_pts[-1])
    pts = salted_join(pts, dense.select("node", F.lit(True).alias("dense")), ["node"], "left", salt_by=["vec"], spread=True)
    pts = pts.withColumn("dense", F.coalesce("dense", F.lit(False))).checkpoint()
    if pts.isEmpty():
        return every.select("_key", "vec", F.transform(places, lambda s: F.lit(NOISE)).alias("labels"),
                            F.transform(places, lambda s: F.lit(False)).alias("cores"))
    cells = make_cells(pts, pivots)
    reach = np.full(len(cells.pivots), eps[-1])

    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, w = stack(left["vec"]), stack(right["vec"]), right["weight"].to_numpy()
        total = np.zeros((len(a), n_eps), dtype=np.int64)
        for s in blocks(len(a), len(b), d):
            dist = distances(a[s], b)
            for e in range(n_eps):
                total[s, e] = (dist <= steps[e]) @ w
        return pd.DataFrame({"vec": objects(a), "n": objects(total)})

    sparse = pts.where(~F.col("dense")).select("vec")
    counted = chunk_apply(cells, sparse, pts.select("vec", "weight"), reach, count, "vec array<double>, n array<bigint>")
    counted = counted.groupBy("vec").agg(F.array(*[F.sum(F.get("n", F.lit(e))) for e in range(n_eps)]).alias("n"))
    level = lambda m: F.when(F.col("dense"), F.lit(0)).otherwise(F.size(F.filter("n", lambda x: x < m)))
    pts = spread_join(pts, counted, ["vec"], "left").withColumn("lev", F.array(*[level(m) for m in min_pts])).withColumn(
        "node", F.when(F.col("dense"), F.col("node")).otherwise(cell_node(F.col("vec")))).drop("n").checkpoint()
    core = pts.where(F.get("lev", F.lit(0)) < n_eps)

    heads = heads_of_cells(core.where("dense"), d).withColumn("lev", F.array(*[F.lit(0)] * n_min))
    asking = core.where(~F.col("dense")).select("vec", "node", "lev").unionByName(heads.select("vec", "node", "lev"))

    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b = stack(left["vec"]), stack(right["vec"])
        la, lb = stack(left["lev"]).astype(np.int64), stack(right["lev"]).astype(np.int64)
        codes, names = pd.factorize(pd.concat([left["node"], right["node"]]))
        ca, cb = codes[:len(a)], codes[len(a):]
        none = np.empty(0, dtype=np.int64)
        forests = [(none, none, none)] * n_min
        for s in blocks(len(a), len(b), d):
            far = np.searchsorted(steps, distances(a[s], b))
            i, j = np.nonzero((far < n_eps) & (ca[s][:, None] != cb[None]))
            for m in range(n_min):
                meet = np.maximum(far[i, j], np.maximum(la[s][i, m], lb[j, m]))
                ok = meet < n_eps
                u, v, w = (np.concatenate(p) for p in zip(forests[m], (ca[s][i[ok]], cb[j[ok]], meet[ok])))
                keep = spanning_forest(u, v, w, n_eps)
                forests[m] = u[keep], v[keep], w[keep]
        return pd.DataFrame({"m": np.concatenate([np.full(len(f[0]), m, dtype="int32") for m, f in enumerate(forests)]),
                             "u": objects(names[i] for f in forests for i in f[0]), "v": objects(names[i] for f in forests for i in f[1]),
                             "level": np.concatenate([f[2] for f in forests]).astype("int32")})

    edges = chunk_apply(cells, asking, core.select("vec", "node", "lev"), reach, link, "m int, u string, v string, level int")
    edges = edges.withColumn("e", F.explode(F.sequence("level", F.lit(n_eps - 1)))).withColumn("s", F.col("m") * n_eps + F.col("e"))
    edges = edges.select(tagged(F.col("s"), F.col("u")).alias("u"), tagged(F.col("s"), F.col("v")).alias("v"))
    nodes = core.select("node", "lev").distinct().withColumn("s", F.explode(F.filter(places, is_core)))
    comp = connected_components(nodes.select(tagged(F.col("s"), F.col("node")).alias("node")), edges, spread=True).checkpoint()
    comp = _join_separate_cells(core, comp, d, steps, n_min).checkpoint()

    named = core.select("vec", "first", "node", F.explode(F.filter(places, is_core)).alias("s"))
    named = salted_join(named.withColumn("node", tagged(F.col("s"), F.col("node"))), comp, ["node"], "inner", salt_by=["vec"], spread=True)
    order = named.groupBy("component").agg(F.min(F.struct("s", "first", "component")).alias("place"))
    order = numbered(order, "place", "number").checkpoint()
    start = order.groupBy(F.col("place.s").alias("s")).agg(F.min("number").alias("start"))      # one row per setting
    order = order.withColumn("s", F.col("place.s")).join(start, "s").select("component", (F.col("number") - F.col("start")).cast("int").alias("prediction"))
    named = salted_join(named, order, ["component"], "inner", salt_by=["vec"], spread=True)
    labelled = named.groupBy("vec").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("s") == s, F.col("prediction"))), F.lit(int(NO_LABEL))) for s in range(settings)]).alias("own")).checkpoint()

    def border(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a, b, label = stack(left["vec"]), stack(right["vec"]), np.vstack(right["own"].to_numpy()).astype("int32")
        best = np.full((len(a), settings), NO_LABEL, dtype="int32")
        for s in blocks(len(a), len(b), d):
            dist = distances(a[s], b)
            for e in range(n_eps):
                near = dist <= steps[e]
                for p in range(e, settings, n_eps):
                    best[s, p] = np.where(near, label[None, :, p], NO_LABEL).min(axis=1)
        return pd.DataFrame({"vec": objects(a), "near": objects(best)})

    # a point that is core in every setting has no label to take from others
    asks = pts.where(~F.col("dense") & (F.get("lev", F.lit(n_min - 1)) > 0)).select("vec")
    near = chunk_apply(cells, asks, labelled, reach, border, "vec array<double>, near array<int>")
    near = near.groupBy("vec").agg(F.array(*[F.min(F.get("near", F.lit(s))) for s in range(settings)]).alias("near"))
    best = lambda s: F.least(F.coalesce(F.get("own", s), F.lit(int(NO_LABEL))), F.coalesce(F.get("near", s), F.lit(int(NO_LABEL))))
    labels = spread_join(spread_join(pts.select("vec", "lev"), labelled, ["vec"], "left"), near, ["vec"], "left").select(
        "vec", F.transform(places, lambda s: F.when(best(s) == int(NO_LABEL), NOISE).otherwise(best(s))).alias("labels"),
        F.transform(places, is_core).alias("cores"))
    out = salted_join(rows, labels, ["vec"], "inner", salt_by=["_key"], spread=True)
    return out.select("_key", "vec", "labels", "cores").unionByName(every.where(gap).select(
        "_key", "vec", F.transform(places, lambda s: F.lit(NOISE)).alias("labels"), F.transform(places, lambda s: F.lit(False)).alias("cores")))


def _join_separate_cells(core: DataFrame, comp: DataFrame, d: int, steps: np.ndarray, n_min: int) -> DataFrame:
    """Full comparison of dense cells that are apart at the eps that spans the gap between their boxes.

    With the largest min_pts the fewest points link, so cells that meet there meet for every min_pts.
    """
    n_eps = len(steps)
    first = (n_min - 1) * n_eps
    dense = core.where("dense")
    if dense.isEmpty():
        return comp
    boxes = dense.groupBy("node").agg(F.array(*[F.min(F.get("vec", F.lit(i))) for i in range(d)]).alias("lo"),
                                      F.array(*[F.max(F.get("vec", F.lit(i))) for i in range(d)]).alias("hi"))
    parts = comp.select(F.split_part("node", F.lit(":"), F.lit(1)).cast("int").alias("s"), F.split_part("node", F.lit(":"), F.lit(2)).alias("node"), "component")
    tops = parts.where(F.col("s") >= first).groupBy("node").agg(F.array(*[
        F.max(F.when(F.col("s") == first + e, F.col("component"))) for e in range(n_eps)]).alias("tops"))
    boxes = spread_join(boxes, tops, ["node"]).withColumn("vec", F.zip_with("lo", "hi", lambda a, b: (a + b) / 2)).checkpoint()
    if boxes.select(F.get("tops", F.lit(0))).distinct().limit(2).count() < 2:
        return comp
    cells = make_cells(boxes)

    def close(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        la, ha, lb, hb = (stack(c) for c in (left["lo"], left["hi"], right["lo"], right["hi"]))
        na, nb = left["node"].to_numpy(), right["node"].to_numpy()
        ta, tb = (np.array([list(t) for t in side["tops"]], dtype=object) for side in (left, right))
        u, v = [], []
        for s in blocks(len(la), len(lb), d):
            gap = np.maximum(0.0, np.maximum(lb[None] - ha[s][:, None], la[s][:, None] - hb[None]))
            span = np.searchsorted(steps, np.sqrt((gap ** 2).sum(axis=2)))
            i, j = np.nonzero(span < n_eps)
            at = span[i, j]
            apart = (na[s][i] < nb[j]) & (ta[s][i, at] != tb[j, at])
            u.extend(na[s][i[apart]])
            v.extend(nb[j[apart]])
        return pd.DataFrame({"u": objects(u), "v": objects(v)})

    # centres of two such boxes are at most the largest eps plus two half diagonals apart
    reach = np.full(len(cells.pivots), steps[-1] + steps[0])
    pairs = chunk_apply(cells, boxes, boxes, reach, close, "u string, v string").checkpoint()
    if pairs.isEmpty():
        return comp

    def touch(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        level = n_eps
        if not left.empty and not right.empty:
            x, y = stack(left["vec"]), stack(right["vec"])
            for s in blocks(len(x), len(y), d):
                level = min(level, int(np.searchsorted(steps, distances(x[s], y).min())))
        if level == n_eps:
            return pd.DataFrame({"u": objects([]), "v": objects([]), "level": np.empty(0, dtype="int32")})
        return pd.DataFrame({"u": objects([left["u"].iloc[0]]), "v": objects([left["v"].iloc[0]]), "level": np.array([level], dtype="int32")})

    met = compare_cells(dense.select("node", "vec"), boxes, pairs, float(steps[-1]), touch, "u string, v string, level int")
    met = met.groupBy("u", "v").agg(F.min("level").alias("level"))
    met = met.withColumn("e", F.explode(F.sequence("level", F.lit(n_eps - 1)))).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n_min - 1))))
    met = met.withColumn("s", F.col("m") * n_eps + F.col("e"))
    met = met.select(F.concat_ws(":", "s", "u").alias("u"), F.concat_ws(":", "s", "v").alias("v"))
    lifted = spread_join(spread_join(met, comp.withColumnsRenamed({"node": "u", "component": "cu"}), ["u"]),
                         comp.withColumnsRenamed({"node": "v", "component": "cv"}), ["v"]).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    groups = connected_components(comp.select(F.col("component").alias("node")).distinct(), lifted, spread=True)
    return spread_join(comp, groups.select(F.col("node").alias("component"), F.col("component").alias("whole")), ["component"]).select(
        "node", F.col("whole").alias("component"))


def _each_setting(labels: DataFrame, eps: list[float], min_pts: list[int]) -> DataFrame:
    """One row per row and setting: ``_key, vec, s, eps, min_pts, prediction, core``."""
    both = F.posexplode(F.arrays_zip("labels", "cores")).alias("s", "_both")
    pairs = [(e, m) for m in min_pts for e in eps]
    out = labels.select("_key", "vec", both)
    return out.select("_key", "vec", "s", F.get(F.array(*[F.lit(e) for e, _ in pairs]), F.col("s")).alias("eps"),
                      F.get(F.array(*[F.lit(m) for _, m in pairs]), F.col("s")).alias("min_pts"),
                      F.col("_both.labels").alias("prediction"), F.col("_both.cores").alias("core"))


def density_grid(df: DataFrame, key: str, features: Sequence[str], eps_values: Sequence[float], min_pts_values: Sequence[int],
                 pivots: int | None = None) -> DataFrame:
    """M14 for every setting at once: ``key, eps, min_pts, prediction, core``, each as ``fit_dbscan`` gives it.

    The neighbours are visited three times (counts, links, borders) whatever the number of settings.
    Rows with a missing feature are noise; an empty table gives no rows.
    """
    eps, min_pts = sorted({float(e) for e in eps_values}), sorted({int(m) for m in min_pts_values})
    labels = _grid_labels(df, key, features, eps, min_pts, pivots)
    return _each_setting(labels, eps, min_pts).select(F.col("_key").alias(key), "eps", "min_pts", "prediction", "core")


def _trials(labels: DataFrame, eps: list[float], min_pts: list[int], noise_limit: float) -> list[tuple]:
    """Cluster count, noise and silhouette of every setting, in ascending order."""
    each = _each_setting(labels, eps, min_pts)
    counts = each.groupBy("s", "eps", "min_pts").agg(
        (F.max("prediction") + 1).alias("n"), (F.avg((F.col("prediction") == NOISE).cast("int")) * 100).alias("noise")).orderBy("eps", "min_pts").collect()
    # centres of several settings go together as long as they are a small frame
    batches, held = [[]], 0
    for r in counts:
        if r["n"] >= 2:
            if held + r["n"] > SMALL_FRAME_ROWS and batches[-1]:
                batches.append([])
                held = 0
            batches[-1].append(r["s"])
            held += r["n"]
    scores = {}
    for batch in batches:
        if batch:
            kept = each.where(F.col("s").isin(batch) & (F.col("prediction") != NOISE))
            scores |= {r["s"]: r["silhouette"] for r in silhouette(kept, "vec", "prediction", by=["s"]).collect()}
    out = []
    for r in counts:
        score = float(scores.get(r["s"], -1.0))
        out.append((r["eps"], r["min_pts"], r["n"], r["noise"], score, bool(r["n"] >= 2 and score > -1.0 and r["noise"] < noise_limit)))
    return out


def _search(df: DataFrame, key: str, features: Sequence[str], eps_values: Sequence[float], min_pts_values: Sequence[int]) -> tuple[DataFrame | None, DataFrame, tuple | None]:
    """Labels of the chosen setting, trials and the setting; no labels and no setting if none is valid."""
    tried, labels, setting = [], None, None
    grids = ((eps_values, min_pts_values, MAX_NOISE_PERCENT, lambda t: t[4]), (CONSERVATIVE_EPS, CONSERVATIVE_MIN_PTS, 100.0 + 1e-9, lambda t: 0))
    for eps_list, min_list, limit, value in grids:
        eps, min_pts = sorted({float(e) for e in eps_list}), sorted({int(m) for m in min_list})
        found = _grid_labels(df, key, features, eps, min_pts, None).checkpoint()
        rows = _trials(found, eps, min_pts, limit)
        tried += rows
        good = [t for t in rows if t[5]]
        if good:
            setting = max(good, key=value)[:2]
            one = _each_setting(found, eps, min_pts).where((F.col("eps") == setting[0]) & (F.col("min_pts") == setting[1]))
            labels = one.select(F.col("_key").alias(key), "prediction", "core")
            break
    table = local_frame(
        df.sparkSession, tried, "eps double, min_pts int, n_clusters int, noise_percentage double, silhouette double, valid boolean")
    return labels, table, setting


def search_dbscan(df: DataFrame, key: str, features: Sequence[str], eps_values: Sequence[float] = tuple(EPS_GRID),
                  min_pts_values: Sequence[int] = tuple(MIN_PTS_GRID)) -> tuple[DataFrame, DataFrame]:
    """M14 grid: the labels with the best silhouette (ties to the smaller eps, then min_pts) among settings
    with at least two clusters and under 80 % noise; then the first valid setting of the conservative grid; then one cluster for all.

    The grid is the same at every size of the table; all settings of a grid share one pass. Returns ``(labels, trials)``;
    the silhouette leaves noise out and is -1 with fewer than two clusters.
    """
    labels, trials, _ = _search(df, key, features, eps_values, min_pts_values)
    return df.select(key, F.lit(0).alias("prediction"), F.lit(True).alias("core")) if labels is None else labels, trials


class DensityModel(Model, HasFeaturesCol, HasPredictionCol, MLWritable, MLReadable):
    """A fitted density clustering as a pipeline stage: rows take the label of the nearest core row within eps, else noise.

    ``cores`` holds ``vec, prediction`` and is saved beside the parameters. Among equally near core rows the smallest label
    counts, so a border row between two clusters may differ from its label in ``fit_dbscan``. Without eps (no valid setting
    was found) every row is in cluster 0.
    """

    eps = Param(Params._dummy(), "eps", "reach of a core row; below 0: one cluster for all", typeConverter=TypeConverters.toFloat)
    minPts = Param(Params._dummy(), "minPts", "rows within eps that make a core row", typeConverter=TypeConverters.toInt)

    def __init__(self, cores: DataFrame | None = None, eps: float = -1.0, min_pts: int = 0):
        super().__init__()
        self.cores = cores
        self._set(eps=eps, minPts=min_pts, featuresCol="features", predictionCol="prediction")

    def _transform(self, df: DataFrame) -> DataFrame:
        eps, label = self.getOrDefault(self.eps), self.getPredictionCol()
        if eps < 0:
            return df.withColumn(label, F.lit(0))
        if self.cores.isEmpty():
            return df.withColumn(label, F.lit(NOISE))
        named = df.withColumn("_vec", feature_array(df, self.getFeaturesCol()))
        near = nearest_core_labels(named.select(F.col("_vec").alias("vec")).distinct(), self.cores, eps)
        near = near.select(F.col("vec").alias("_vec"), F.col("prediction").alias("_near"))
        salt = [f"`{f.name}`" for f in df.schema if f.dataType.typeName() not in ("map", "udt", "vectorudt", "variant")]
        out = salted_join(named, near, ["_vec"], "left", salt_by=salt or ["_vec"], spread=True)
        return out.withColumn(label, F.coalesce("_near", F.lit(NOISE))).drop("_vec", "_near")

    def write(self) -> MLWriter:
        return _DensityWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _DensityReader()


class _DensityWriter(MLWriter):
    def __init__(self, model: DensityModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        if self.model.cores is not None:
            self.model.cores.write.parquet(f"{path}/cores")


class _DensityReader(MLReader):
    def load(self, path: str) -> DensityModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = DensityModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        if model.getOrDefault(model.eps) >= 0:
            model.cores = self.sparkSession.read.parquet(f"{path}/cores")
        return model


def fit_density_model(df: DataFrame, key: str, eps: float | None = None, min_pts: int | None = None, features: str = "features",
                      eps_values: Sequence[float] = tuple(EPS_GRID), min_pts_values: Sequence[int] = tuple(MIN_PTS_GRID)) -> tuple[DensityModel, DataFrame | None]:
    """A density clustering of a feature vector as a pipeline stage, and the trials if the setting was searched."""
    first = df.select(feature_array(df, features).alias("_v")).first()
    if first is None:
        raise ValueError("no rows")
    names = [f"_f{i}" for i in range(len(first["_v"]))]
    flat = df.select(key, feature_array(df, features).alias("vec")).select(key, "vec", *[F.get("vec", F.lit(i)).alias(n) for i, n in enumerate(names)])
    if eps is not None and min_pts is not None:
        labels, trials, setting = fit_dbscan(flat, key, names, eps, min_pts), None, (eps, min_pts)
    else:
        labels, trials, setting = _search(flat, key, names, eps_values if eps is None else [eps], min_pts_values if min_pts is None else [min_pts])
    if setting is None:
        return DensityModel(), trials
    cores = spread_join(flat, labels.where("core"), [key]).groupBy("vec").agg(F.min("prediction").alias("prediction")).checkpoint()
    return DensityModel(cores, *setting), trials
