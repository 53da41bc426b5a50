import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import balance as B, dbscan as D, density as G
from featurelens.operators.components import connected_components
from featurelens.operators.neighbours import distinct_points, knn
import featurelens.operators.components as CO
import featurelens.operators.neighbours as N


def ring_points():
    rng = random.Random(3)
    pts = []
    for cx, cy, r, n in ((0, 0, 1.0, 60), (5, 5, 1.5, 60), (-4, 4, 0.6, 50)):
        for _ in range(n):
            a = rng.random() * 2 * math.pi
            pts.append((cx + r * math.cos(a) + rng.gauss(0, 0.05), cy + r * math.sin(a) + rng.gauss(0, 0.05)))
    pts += [(rng.uniform(-8, 8), rng.uniform(-8, 8)) for _ in range(30)]
    pts += [pts[0]] * 40          # copies
    pts += [(9.0 + i * 1e-4, 9.0) for i in range(60)]     # a dense clump
    return pts


def brute_dbscan(pts, eps, min_pts):
    x = np.array(pts)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= min_pts
    label = np.full(len(x), -1)
    nxt = 0
    for i in range(len(x)):
        if core[i] and label[i] == -1:
            stack, label[i] = [i], nxt
            while stack:
                for k in np.flatnonzero(near[stack.pop()] & core & (label == -1)):
                    label[k] = nxt
                    stack.append(k)
            nxt += 1
    for i in np.flatnonzero(~core):
        labels = label[near[i] & core]
        if len(labels):
            label[i] = labels.min()
    return label, core


@pytest.mark.parametrize("eps,min_pts", [(0.5, 4), (1.2, 6), (0.3, 3)])
def test_dbscan_equals_brute_force(spark, eps, min_pts):
    pts = ring_points()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id bigint, x double, y double").repartition(3)
    got = {r["id"]: (r["prediction"], r["core"]) for r in D.fit_dbscan(df, "id", ["x", "y"], eps, min_pts).collect()}
    label, core = brute_dbscan(pts, eps, min_pts)
    assert [got[i][1] for i in range(len(pts))] == list(core)
    assert [got[i][0] for i in range(len(pts))] == list(label)


def test_dbscan_small_chunks_and_four_dimensions(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_CHUNK", 20)
    monkeypatch.setattr(N, "POINT_CHUNK", 30)
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(c, 0.4, (60, 4)) for c in (0, 2, 5)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id bigint, a double, b double, c double, d double")
    got = {r["id"]: r["prediction"] for r in D.fit_dbscan(df, "id", list("abcd"), 0.7, 5, pivots=4).collect()}
    assert [got[i] for i in range(len(pts))] == list(brute_dbscan(pts, 0.7, 5)[0])


def test_dense_cells_joined_only_by_inner_points(spark):
    # two dense cells whose extreme points are apart but whose inner points are within eps
    eps = 1.0
    side = eps / math.sqrt(2)
    left = [(0.10 * side, 0.02), (0.12 * side, 0.98 * side), (0.01, 0.5 * side), (0.5 * side, 0.5 * side)] * 2
    right = [(x + 1.95 * side, y) for x, y in left]
    pts = left + right + [(20.0, 20.0)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pts)], "id bigint, x double, y double")
    got = {r["id"]: r["prediction"] for r in D.fit_dbscan(df, "id", ["x", "y"], eps, 4).collect()}
    assert [got[i] for i in range(len(pts))] == list(brute_dbscan(pts, eps, 4)[0])


def test_new_rows_take_the_nearest_core_label(spark):
    pts = ring_points()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id bigint, x double, y double")
    fitted = D.fit_dbscan(df, "id", ["x", "y"], 0.5, 4)
    new = spark.createDataFrame([(0, 9.01, 9.1), (1, 100.0, 100.0)], "id bigint, x double, y double")
    got = {r["id"]: r["prediction"] for r in D.assign_dbscan(new, "id", ["x", "y"], fitted, df, 0.5).collect()}
    clump = {r["id"]: r["prediction"] for r in fitted.collect()}[len(pts) - 1]
    assert got == {0: clump, 1: -1}


def test_dbscan_search_falls_back_to_one_cluster(spark):
    df = spark.createDataFrame([(i, float(i * 1000)) for i in range(6)], "id bigint, x double")
    labels, trials = G.search_dbscan(df, "id", ["x"], [0.1], [3])
    assert {r["prediction"] for r in labels.collect()} == {0}
    assert trials.where("valid").count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_knn_equals_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(N, "QUERY_CHUNK", 25)
        monkeypatch.setattr(N, "POINT_CHUNK", 40)
    pts = np.array(ring_points())
    df = spark.createDataFrame([(list(map(float, p)),) for p in pts], "vec array<double>").repartition(5)
    got = {}
    for r in knn(distinct_points(df, "vec"), 4, pivots=7 if small else None).collect():
        got.setdefault(tuple(r["vec"]), []).extend([r["distance"]] * r["weight"])
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    for i, p in enumerate(pts):
        want = np.sort(np.delete(d[i], i))[:4]
        assert sorted(got[tuple(p)]) == pytest.approx(list(want), abs=1e-9)


@pytest.mark.parametrize("salt_over", [0, 1_000_000])
def test_components(spark, monkeypatch, salt_over):
    plain = CO.salted_join
    monkeypatch.setattr(CO, "salted_join", lambda a, b, k: plain(a, b, k, salt_over=salt_over))
    nodes = spark.createDataFrame([(c,) for c in "abcdefghij"], "node string")
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("f", "e"), ("g", "f"), ("j", "j")]
    got = {r["node"]: r["component"] for r in connected_components(nodes, spark.createDataFrame(chain, "u string, v string")).collect()}
    assert got == dict(zip("abcdefghij", "aaaaeeehij"))


def test_long_chain_component(spark):
    n = 300
    nodes = spark.range(n).select(F.format_string("%05d", "id").alias("node"))
    edges = spark.range(n - 1).select(F.format_string("%05d", "id").alias("u"), F.format_string("%05d", F.col("id") + 1).alias("v"))
    assert {r["component"] for r in connected_components(nodes, edges).collect()} == {"00000"}


def test_oversample_counts(spark):
    df = spark.range(1000).select("id", (F.col("id") < 30).cast("int").alias("y"), F.lit(1.5).alias("x"))
    out = B.oversample(df, "y", "id", 0.2)
    assert out.where("copy = 0").select("id").exceptAll(df.select("id")).count() == 0
    minority = out.where("y = 1").count()
    assert abs(minority - int(970 * 0.2)) <= 20
    assert out.where("y = 0").count() == 970


def test_smote_points_lie_between_neighbours(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(i < 40), float(a), int(b)) for i, (a, b) in enumerate(zip(rng.normal(0, 1, 900), rng.integers(0, 9, 900)))]
    df = spark.createDataFrame(rows, "id bigint, y int, x double, n int")
    out = B.smote(df, "y", "id", ["x", "n"], 0.2, 3)
    made = out.where("synthetic").collect()
    xs = [r[2] for r in rows if r[1]]
    assert abs(len(made) - (int(860 * 0.2) - 40)) <= 25
    assert all(r["y"] == 1 and min(xs) <= r["x"] <= max(xs) and isinstance(r["n"], int) for r in made)
    assert out.where("NOT synthetic").count() == 900


def test_smote_with_few_rows_replicates(spark):
    df = spark.range(500).select("id", (F.col("id") < 2).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    made = B.smote(df, "y", "id", ["x"], 0.1, 5).where("synthetic")
    assert {r["x"] for r in made.collect()} <= {0.0, 1.0} and made.count() > 10


def test_assign_without_core_rows(spark):
    df = spark.createDataFrame([(i, float(i * 1000)) for i in range(6)], "id bigint, x double")
    fitted = D.fit_dbscan(df, "id", ["x"], 0.5, 3)
    assert {r["prediction"] for r in D.assign_dbscan(df, "id", ["x"], fitted, df, 0.5).collect()} == {-1}


@pytest.mark.parametrize("few,k", [(30, 3), (4, 5), (1, 1)])
def test_smote_adds_exactly_the_rows_it_needs(spark, few, k):
    rows = [(i, 0, float(i % 17), 1.0) for i in range(997)] + [(2000 + i, 1, 50.0 + i % 7, None if i % 3 else 4.0) for i in range(few)]
    df = spark.createDataFrame(rows, "id bigint, y int, x double, g double").repartition(4)
    for ratio in (0.08, 0.111):
        made = B.smote(df, "y", "id", ["x", "g"], ratio, k).where("synthetic").collect()
        assert len(made) == int(997 * ratio) - few
        # a gap counts as the class mean, not as 0
        assert all(r["y"] == 1 and 50.0 <= r["x"] <= 56.0 and abs(r["g"] - 4.0) < 1e-9 for r in made)
