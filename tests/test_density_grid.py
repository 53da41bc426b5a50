"""All settings of a density grid at once against brute force and the single fit."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import featurelens.operators.neighbours as N
from featurelens.operators import density as G
from tests.test_neighbours import brute_dbscan, ring_points


def grid_equals_brute_force(spark, pts, eps_values, min_pts_values, pivots=None):
    names = [f"x{i}" for i in range(len(pts[0]))]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id bigint, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {}
    for r in G.density_grid(df, "id", names, eps_values, min_pts_values, pivots).collect():
        got.setdefault((r["eps"], r["min_pts"]), {})[r["id"]] = (r["prediction"], r["core"])
    assert sorted(got) == sorted((e, m) for e in eps_values for m in min_pts_values)
    for (eps, min_pts), rows in got.items():
        label, core = brute_dbscan(pts, eps, min_pts)
        assert [rows[i][1] for i in range(len(pts))] == list(core), (eps, min_pts)
        assert [rows[i][0] for i in range(len(pts))] == list(label), (eps, min_pts)


def test_every_setting_equals_brute_force(spark):
    grid_equals_brute_force(spark, ring_points(), [0.3, 0.5, 1.2, 3.0], [3, 4, 8])


def test_small_chunks_and_four_dimensions(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_CHUNK", 20)
    monkeypatch.setattr(N, "POINT_CHUNK", 30)
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(c, 0.4, (60, 4)) for c in (0, 2, 5)])
    grid_equals_brute_force(spark, pts, [0.4, 0.7, 1.5], [3, 5], pivots=4)


def test_dense_cells_joined_only_by_inner_points(spark):
    side = 1.0 / math.sqrt(2)
    left = [(0.10 * side, 0.02), (0.12 * side, 0.98 * side), (0.01, 0.5 * side), (0.5 * side, 0.5 * side)] * 2
    right = [(x + 1.95 * side, y) for x, y in left]
    further = [(x + 4.6 * side, y) for x, y in left]
    grid_equals_brute_force(spark, left + right + further + [(20.0, 20.0)], [1.0, 1.4, 2.0], [2, 4])


def test_many_inner_links_of_dense_cells(spark, monkeypatch):
    # few representatives, so that most links of dense cells need the full comparison
    import featurelens.operators.dbscan as D
    monkeypatch.setattr(D, "REPRESENTATIVES", 2)
    rng = np.random.default_rng(11)
    centres = rng.uniform(0, 6, (25, 2))
    pts = np.vstack([c + rng.uniform(-0.12, 0.12, (12, 2)) for c in centres])
    grid_equals_brute_force(spark, pts, [0.35, 0.6, 0.9, 1.3], [2, 3, 5])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id bigint, x double, y double")
    got = {r["id"]: r["prediction"] for r in D.fit_dbscan(df, "id", ["x", "y"], 0.6, 3).collect()}
    assert [got[i] for i in range(len(pts))] == list(brute_dbscan(pts, 0.6, 3)[0])


def test_a_third_in_one_place_gaps_and_empty_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 5.0, 5.0) for i in range(100)] + [(100 + i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 10, (200, 2)))]
    df = spark.createDataFrame(rows + [(900, None, 1.0), (901, 1.0, None)], "id bigint, x double, y double").withColumn("vec", F.lit("clash"))
    out = G.density_grid(df, "id", ["x", "y"], [0.5, 1.0], [4])
    assert out.count() == 2 * 302
    assert {(r["prediction"], r["core"]) for r in out.where("id >= 900").collect()} == {(-1, False)}
    label, _ = brute_dbscan([(x, y) for _, x, y in rows], 1.0, 4)
    assert {r["id"]: r["prediction"] for r in out.where("eps = 1.0 AND id < 900").collect()} == dict(enumerate(label.tolist()))
    assert G.density_grid(df.limit(0), "id", ["x", "y"], [0.5], [4]).count() == 0
    assert {r["prediction"] for r in G.density_grid(df.where("id >= 900"), "id", ["x", "y"], [0.5], [4]).collect()} == {-1}
    with pytest.raises(ValueError):
        G.density_grid(df, "id", ["x", "y"], [0.0, 0.5], [4])


def test_spanning_forest_keeps_every_level():
    rng = np.random.default_rng(4)
    u, v, level = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 5, 400)

    def parts(u, v):
        root = np.arange(60)
        for _ in range(60):
            np.minimum.at(root, u, root[v])
            np.minimum.at(root, v, root[u])
        return root

    keep = G.spanning_forest(u, v, level, 5)
    for lv in range(5):
        at = keep[level[keep] <= lv]
        assert (parts(u[level <= lv], v[level <= lv]) == parts(u[at], v[at])).all()
        assert len(at) == 60 - len(set(parts(u[at], v[at])))
    assert len(G.spanning_forest(u[:0], v[:0], level[:0], 5)) == 0


def test_search_chooses_a_setting_and_the_model_is_saved(spark, tmp_path):
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(c, 0.15, (80, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id bigint, x double, y double")
    labels, trials = G.search_dbscan(df, "id", ["x", "y"], [0.3, 0.5], [4])
    assert labels.where("prediction >= 0").select("prediction").distinct().count() == 3 and trials.where("valid").count() == 2
    vectors = df.withColumn("features", array_to_vector(F.array("x", "y")))
    model, trials = G.fit_density_model(vectors, "id", eps_values=[0.3, 0.5], min_pts_values=[4])
    assert trials.count() == 2
    PipelineModel([model]).write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    new = vectors.unionByName(spark.createDataFrame([(999, 50.0, 50.0)], "id bigint, x double, y double").withColumn("features", array_to_vector(F.array("x", "y"))))
    got = {r["id"]: r["prediction"] for r in again.transform(new).collect()}
    assert got[999] == -1 and [len({got[i] for i in range(80 * c, 80 * c + 80)} - {-1}) for c in range(3)] == [1, 1, 1]
    # no valid setting: one cluster for all
    lone, _ = G.fit_density_model(vectors.limit(1), "id", eps_values=[0.3], min_pts_values=[4])
    assert [r["prediction"] for r in lone.transform(vectors.limit(2)).collect()] == [0, 0]
