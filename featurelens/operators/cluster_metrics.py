"""Cluster quality from per-cluster sums. Features are ``array<double>``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.functions.expressions import field_type
from featurelens.operators.shared import join_groups, pin_small

CENTRES = 256       # centres in a chunk; a task compares two chunks


def feature_array(df: DataFrame, features: str) -> Column:
    kind = field_type(df, features).typeName()
    return F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features)


def centres(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """One row per cluster: size, centre and sum of squared distances to the centre.

    A single grouped pass; the squared distances come from the per-dimension
    variances, so no second read and no join is needed.
    """
    vec = array_to_vector(feature_array(df, features))
    s = Summarizer.metrics("count", "mean", "variance").summary(vec)
    agg = df.groupBy(*by, F.col(cluster).alias("cluster")).agg(s.alias("_s"))
    spread = F.aggregate(vector_to_array("_s.variance"), F.lit(0.0), lambda a, x: a + x)
    return agg.select(*by, "cluster", F.col("_s.count").alias("size"), vector_to_array("_s.mean").alias("centre"),
                      (spread * (F.col("_s.count") - 1)).alias("within"))


def _sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def inertia(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Sum of squared distances to the own centre."""
    return centres(df, features, cluster, by).groupBy(*by).agg(F.sum("within").alias("inertia"))


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``df`` with group columns: a constant one if there are none."""
    return (df, list(by)) if by else (df.withColumn("_k", F.lit(1)), ["_k"])


def _centre_pairs(table: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """Chunks of centres side by side: every two centres of a group meet in the array ``_c`` of one row.

    ``_other(a, b)`` tells for each row which of them are to be compared there.
    """
    table, keys = _keyed(table, by)
    sizes = table.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / CENTRES).cast("int").alias("_n"))
    dealt = join_groups(table, sizes, keys).withColumn("_p", F.pmod(F.xxhash64("cluster"), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.groupBy(*keys, F.least("_p", "_q").alias("_low"), F.greatest("_p", "_q").alias("_high")).agg(
        F.array_sort(F.collect_list(F.struct("cluster", "_p", *columns))).alias("_c"))


def _other(a: Column, b: Column) -> Column:
    return (a["cluster"] != b["cluster"]) & ((a["_p"] != b["_p"]) | (F.col("_low") == F.col("_high")))


def calinski_harabasz(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Between over within variance ratio; null with one cluster."""
    return _calinski(centres(df, features, cluster, by), by)


def _calinski(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals of each group, then the distances of its centres from the mean as a grouped sum: no group is gathered."""
    keys = [*by, "_all"]
    table = table.withColumn("_all", F.lit(1))
    mean = Summarizer.metrics("mean").summary(array_to_vector("centre"), F.col("size").cast("double"))
    total = table.groupBy(*keys).agg(vector_to_array(mean["mean"]).alias("_m"), F.sum("size").alias("_n"), F.count(F.lit(1)).alias("_k"), F.sum("within").alias("_w"))
    between = join_groups(table, total.select(*keys, "_m"), keys).groupBy(*keys).agg(F.sum(F.col("size") * _sq(F.col("centre"), F.col("_m"))).alias("_b"))
    ratio = F.try_divide(F.col("_b") / F.nullif(F.col("_k") - 1, F.lit(0)), F.col("_w") / F.nullif(F.col("_n") - F.col("_k"), F.lit(0)))
    return join_groups(total, between, keys).select(*by, ratio.alias("calinski_harabasz"))


def cluster_sizes(df: DataFrame, cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Number of clusters, sizes and balance (std / mean of the sizes)."""
    sizes = df.groupBy(*by, F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    out = sizes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_clusters"), F.min("size").alias("min_cluster_size"), F.max("size").alias("max_cluster_size"),
        F.avg("size").alias("mean_cluster_size"), F.stddev_pop("size").alias("cluster_size_std"), F.sum("size").alias("sample_count"))
    return out.withColumn("cluster_balance", F.col("cluster_size_std") / F.col("mean_cluster_size"))


def centre_distances(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and mean distance between two centres."""
    return _centre_distances(centres(df, features, cluster, by), by)


def _centre_distances(table: DataFrame, by: Sequence[str]) -> DataFrame:
    pairs = F.flatten(F.transform("_c", lambda a, i: F.transform(
        F.filter(F.slice("_c", i + 2, F.size("_c")), lambda b: _other(a, b)), lambda b: F.sqrt(_sq(a["centre"], b["centre"])))))
    out = _centre_pairs(table, by, "centre").select(*by, pairs.alias("_d"))
    out = out.select(*by, F.array_min("_d").alias("_low"), F.array_max("_d").alias("_high"), F.size("_d").alias("_m"),
                     F.aggregate("_d", F.lit(0.0), lambda a, x: a + x).alias("_sum"))
    return out.groupBy(*by).agg(
        F.min("_low").alias("min_inter_cluster_distance"), F.max("_high").alias("max_inter_cluster_distance"),
        (F.sum("_sum") / F.nullif(F.sum("_m"), F.lit(0))).alias("mean_inter_cluster_distance"))


def point_geometry(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = (),
                   keep: Sequence[str] = (), table: DataFrame | None = None) -> DataFrame:
    """E24 per row: distance to the own centre and squared-Euclidean silhouette.

    The mean squared distance of a row to a cluster follows from its centre and
    spread, so each row is compared with k centres and never with other rows.
    Only the centre table (clusters by dimensions) is sent to the tasks.
    """
    by = list(by)
    table = centres(df, features, cluster, by) if table is None else table
    name = F.concat_ws("\x1f", F.lit(""), *[F.coalesce(F.concat(F.lit("v"), F.col(b).cast("string")), F.lit("null")) for b in by])
    _, rows = pin_small(table.select(name.alias("_name"), "cluster", "size", "centre", "within").orderBy("cluster"))
    packs: dict[str, tuple] = {}
    for r in rows:
        packs.setdefault(r["_name"], []).append((r["cluster"], r["size"], r["centre"], r["within"]))
    packed = {name: (np.array([c[0] for c in cs]), np.array([c[1] for c in cs], dtype=float),
                     np.array([c[2] for c in cs], dtype=float), np.array([c[3] for c in cs], dtype=float)) for name, cs in packs.items()}

    @F.pandas_udf("struct<distance:double,silhouette:double>")
    def geometry(group: pd.Series, label: pd.Series, vecs: pd.Series) -> pd.DataFrame:
        dist, sil = np.empty(len(label)), np.empty(len(label))
        for name, idx in group.groupby(group).groups.items():
            pos = group.index.get_indexer(idx)
            ids, n, c, w = packed[name]
            x = np.vstack(vecs.iloc[pos].to_numpy()).astype(float)
            d2 = np.empty((len(x), len(ids)))
            for j in range(len(ids)):
                d2[:, j] = ((x - c[j]) ** 2).sum(axis=1)
            own = np.searchsorted(ids, label.iloc[pos].to_numpy()) if np.all(np.diff(ids) > 0) else np.array(
                [int(np.flatnonzero(ids == v)[0]) for v in label.iloc[pos]])
            at = np.arange(len(x))
            dist[pos] = np.sqrt(d2[at, own])
            mean = d2 + (w / n)[None, :]
            size = n[own]
            inner = np.where(size > 1, mean[at, own] * size / np.maximum(size - 1, 1), 0.0)
            if len(ids) < 2:
                sil[pos] = np.nan
                continue
            mean[at, own] = np.inf
            outer = mean.min(axis=1)
            top = np.maximum(inner, outer)
            value = np.where(top > 0, (outer - inner) / np.where(top > 0, top, 1.0), 0.0)
            sil[pos] = np.where(size > 1, value, 0.0)
        return pd.DataFrame({"distance": dist, "silhouette": sil})

    out = df.select(*by, *keep, F.col(cluster).alias("cluster"), geometry(name, F.col(cluster), feature_array(df, features)).alias("_g"))
    return out.select(*by, *keep, "cluster", F.col("_g.distance").alias("distance"),
                      F.nanvl("_g.silhouette", F.lit(None).cast("double")).alias("silhouette"))


def silhouette(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Mean silhouette; -1 with a single cluster."""
    return point_geometry(df, features, cluster, by).groupBy(*by).agg(F.coalesce(F.avg("silhouette"), F.lit(-1.0)).alias("silhouette"))


def silhouette_by_cluster(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """E24 summary: size, mean, min, max silhouette and share of negative rows per cluster."""
    return point_geometry(df, features, cluster, by).groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("silhouette").alias("mean_silhouette"), F.min("silhouette").alias("min_silhouette"),
        F.max("silhouette").alias("max_silhouette"), F.avg((F.col("silhouette") < 0).cast("int")).alias("negative_share"))


def cluster_density(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Size and mean distance to the centre per cluster."""
    return point_geometry(df, features, cluster, by).groupBy(*by, "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))


def centre_rows(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centres as ``(cluster, dimension, value)`` rows."""
    return table.select(*by, "cluster", F.posexplode("centre").alias("dimension", "value"))


def davies_bouldin(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Mean over the clusters of the worst (s_i + s_j) / d_ij; null with one cluster."""
    table = centres(df, features, cluster, by)
    return _davies(table, point_geometry(df, features, cluster, by, table=table), by)


def _davies(table: DataFrame, geometry: DataFrame, by: Sequence[str]) -> DataFrame:
    spread = geometry.groupBy(*by, "cluster").agg(F.avg("distance").alias("s"))
    return _davies_of(join_groups(table, spread, [*by, "cluster"]), by)


def _davies_of(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """From centres with their mean distance ``s``; null if two centres are equal and have no other."""
    worst = F.transform("_c", lambda a: F.struct(a["cluster"].alias("cluster"), F.array_max(F.transform(
        F.filter("_c", lambda b: _other(a, b)),
        lambda b: F.try_divide(a["s"] + b["s"], F.sqrt(_sq(a["centre"], b["centre"]))))).alias("worst")))
    each = _centre_pairs(table, by, "centre", "s").select(*by, F.explode(worst).alias("_w")).groupBy(*by, "_w.cluster").agg(F.max("_w.worst").alias("worst"))
    whole = (F.count(F.lit(1)) > 1) & (F.count("worst") == F.count(F.lit(1)))
    return each.groupBy(*by).agg(F.when(whole, F.avg("worst")).alias("davies_bouldin"))


def evaluate_clusters(df: DataFrame, features: str = "features", cluster: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """E17-E22 in one row per group: one grouped pass for the sums, one for the rows."""
    by = list(by)
    slim = df.select(*by, features, cluster).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _evaluate(slim, features, cluster, by)
    finally:
        slim.unpersist()


def _evaluate(df: DataFrame, features: str, cluster: str, by: list[str]) -> DataFrame:
    table, _ = pin_small(centres(df, features, cluster, by))
    geometry = point_geometry(df, features, cluster, by, table=table)
    per = geometry.groupBy(*by, "cluster").agg(
        F.avg("distance").alias("s"), F.sum("silhouette").alias("_sil"), F.count("silhouette").alias("_m"))
    per, _ = pin_small(per)
    base = table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_clusters"), F.sum("size").alias("sample_count"), F.sum("within").alias("inertia"),
        F.min("size").alias("min_cluster_size"), F.max("size").alias("max_cluster_size"), F.avg("size").alias("mean_cluster_size"),
        F.stddev_pop("size").alias("cluster_size_std"), (F.stddev_pop("size") / F.avg("size")).alias("cluster_balance"))
    sil = per.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum("_sil"), F.sum("_m")), F.lit(-1.0)).alias("silhouette"))
    db = _davies_of(join_groups(table, per, [*by, "cluster"]), by)
    out, keys = _keyed(base, by)
    for part in (sil, _calinski(table, by), db, _centre_distances(table, by)):
        out = join_groups(out, _keyed(part, by)[0], keys)
    return out if by else out.drop("_k")


def noise_summary(df: DataFrame, features: str = "features", cluster: str = "prediction") -> DataFrame:
    """Silhouette without noise (label -1), cluster count and noise percentage."""
    noise = df.agg(F.count(F.lit(1)).alias("rows"), (F.avg((F.col(cluster) == -1).cast("int")) * 100).alias("noise_percentage"))
    kept = df.where(F.col(cluster) != -1)
    n = kept.select(cluster).distinct().agg(F.count(F.lit(1)).alias("n_clusters"))
    s = silhouette(kept, features, cluster)
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(noise).join(one(n), "_k").join(one(s), "_k").drop("_k")


def project_2d(df: DataFrame, features: str = "features", keep: Sequence[str] = ()) -> tuple[DataFrame, list[float]]:
    """Two principal components of every row and their explained variance shares."""
    vec = df.select(*keep, array_to_vector(feature_array(df, features)).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(vec)
    p = vector_to_array("_p")
    out = model.transform(vec).select(*keep, p.getItem(0).alias("pc1"), p.getItem(1).alias("pc2"))
    return out, [float(v) for v in model.explainedVariance]


def find_elbow(table: DataFrame) -> DataFrame:
    """K of the largest second difference of inertia; no row with fewer than three k."""
    w = W.orderBy("k")      # one row per tried k
    bend = F.lead("inertia").over(w) - 2 * F.col("inertia") + F.lag("inertia").over(w)
    second = table.where(F.col("inertia").isNotNull()).select("k", bend.alias("bend")).where(F.col("bend").isNotNull())
    return second.agg(F.max_by("k", F.struct("bend", -F.col("k"))).alias("elbow_k")).where(F.col("elbow_k").isNotNull())


def recommend_k(table: DataFrame) -> DataFrame:
    """The k each criterion suggests (ties to the smaller k)."""
    best = lambda c: F.max_by("k", F.struct(F.col(c), -F.col("k"))).cast("int")
    least = F.min_by("k", F.struct("davies_bouldin", "k"))
    s = table.where(F.col("silhouette") > 0).agg(best("silhouette").alias("k")).select(F.lit("silhouette").alias("criterion"), "k")
    c = table.where(F.col("calinski_harabasz") > 0).agg(best("calinski_harabasz").alias("k")).select(F.lit("calinski_harabasz").alias("criterion"), "k")
    d = table.where(F.col("davies_bouldin").isNotNull()).agg(least.cast("int").alias("k")).select(F.lit("davies_bouldin").alias("criterion"), "k")
    e = find_elbow(table).select(F.lit("elbow").alias("criterion"), F.col("elbow_k").cast("int").alias("k"))
    return e.unionByName(s).unionByName(c).unionByName(d).where(F.col("k").isNotNull())


def compare_datasets(metrics: DataFrame) -> DataFrame:
    """Best dataset and deviation of the silhouette, one cluster count or not, rows in total.

    ``metrics`` has one row per dataset as ``evaluate_clusters`` gives it.
    """
    return metrics.agg(
        F.max_by("dataset", F.struct("silhouette", "dataset")).alias("best_silhouette_dataset"),
        F.stddev_pop("silhouette").alias("silhouette_std"),
        (F.min("num_clusters") == F.max("num_clusters")).alias("consistent_cluster_count"),
        F.sum("sample_count").alias("total_samples"))
