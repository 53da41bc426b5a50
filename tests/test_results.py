"""The queries of trained models return the operator's own rows; the facts beside them come from the fit."""

import pytest

import __spark_entry__ as entry
from workload import model_queries as Q


@pytest.mark.parametrize("name,columns", [
    ("m4_decision_tree", {"key", "label", "prediction", "score"}), ("m9_decision_tree_regressor", {"key", "label", "prediction"}), ("m11_kmeans", {"vec_id", "prediction"}),
    ("fs2_forest_importance", {"feature", "importance"}), ("h1_grid_search", {"trial", "params", "score"}), ("e25_elbow_table", {"k", "inertia", "silhouette"}),
    ("g2_positive_probability", {"key", "score"}), ("g4_score_clusters", {"prediction", "size", "silhouette"}), ("l3_fit_clusterer", {"dataset", "metric", "value", "model"})])
def test_result_has_the_operators_rows(spark, sf, name, columns):
    out = entry.queries()[f"{name}_result"](spark, sf)
    assert columns <= set(out.columns) and out.count() > 1


def test_rankings_name_every_feature(spark, sf):
    assert {r["feature"] for r in Q.fs6_result(spark, sf).collect()} == set(Q.FEATURES)
    assert Q.x1_result(spark, sf).count() > 1


def test_a_regressor_worse_than_the_mean_is_seen(spark, sf):
    rows = entry.queries()["m10_fm_regression_result"](spark, sf).toPandas()
    error = ((rows["label"] - rows["prediction"]) ** 2).mean() ** 0.5
    assert entry.queries()["m10_fm_regression"](spark, sf).first()["beats_mean"] == (error <= rows["label"].std(ddof=0))


def test_rows_lost_in_a_fit_show(spark, sf, monkeypatch):
    whole = entry.queries()["h1_grid_search"](spark, sf).first()["train_rows"]
    search = Q.H.score_maps
    monkeypatch.setattr(Q.H, "score_maps", lambda make, maps, train, *a: search(make, maps, train.where("key % 2 = 0"), *a))
    assert entry.queries()["h1_grid_search"](spark, sf).first()["train_rows"] < whole
