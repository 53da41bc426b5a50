"""No path loses rows or scores them wrongly: nulls, NaN, null groups, empty features, other targets; small and cut paths alike."""

import math

import pytest
from pyspark.sql import functions as F

from featurelens.operators import binary_metrics as BM, drift as D, explain, ordering as O, profile as P, regression_metrics as RM, tune
from featurelens.operators.dbscan import fit_dbscan
from featurelens.plans.pipeline import FitConfig, fit_classifier, fit_clusterer


@pytest.fixture(scope="module")
def dirty(spark):
    """Scores with ties, nulls and NaN in three groups, one of them null."""
    rows = []
    for i in range(600):
        score = None if i % 11 == 0 else math.nan if i % 13 == 0 else (i * 37 % 50) / 50
        rows.append((i, ("a", "b", None)[i % 3], score, int((i * 37 % 50) > 20), float(i % 7)))
    return spark.createDataFrame(rows, "key long, dataset string, score double, label int, value double")


def by_hand(dirty):
    order = lambda s: (2, 0) if s is None else (0, 0) if math.isnan(s) else (1, -s)
    groups = {}
    for r in dirty.collect():
        groups.setdefault(r["dataset"], []).append(order(r["score"]))
    return {g: sorted(v) for g, v in groups.items()}


@pytest.mark.parametrize("rows_per_task", [2_000_000, 60, 7])
def test_order_keeps_every_row(dirty, rows_per_task):
    out = O.row_numbers(dirty, "score", ["key"], ["dataset"], rows_per_task=rows_per_task).collect()
    order = lambda s: (2, 0) if s is None else (0, 0) if math.isnan(s) else (1, -s)
    got = {}
    for r in sorted(out, key=lambda r: r["row_number"]):
        got.setdefault(r["dataset"], []).append(order(r["score"]))
    assert len(out) == 600 and got == by_hand(dirty)
    tiles = O.ntiles(dirty, "score", ["key"], ["dataset"], rows_per_task=rows_per_task)
    assert tiles.count() == 600 and tiles.where("decile IS NULL").count() == 0
    plain = O.row_numbers(dirty, "score", ["key"], ["dataset"]).select("key", "row_number")
    cut = O.row_numbers(dirty, "score", ["key"], ["dataset"], rows_per_task=rows_per_task).select("key", "row_number")
    assert plain.exceptAll(cut).isEmpty()


def test_null_group_in_every_metric(dirty):
    clean = dirty.where("score IS NOT NULL AND NOT isnan(score)").withColumn("prediction", (F.col("score") > 0.4).cast("int"))
    for rows_per_task in (2_000_000, 50):
        wide = BM.validate_binary(clean, "key", rows_per_task=rows_per_task).collect()
        assert len(wide) == 9 and all(r["value"] is not None for r in wide)
        assert {r["value"] for r in wide if r["metric"] == "roc"} == {1.0}
    numbers = clean.withColumn("target", F.col("value") + 1)
    assert {r["dataset"] for r in RM.error_summary(numbers, "target", "score", ["dataset"], exact=True).collect()} == {"a", "b", None}
    assert P.numeric_univariate(dirty, ["value"], ["dataset"], exact=True).where("median IS NULL").count() == 0
    assert P.categorical_univariate(dirty.withColumn("c", F.lit("x")), ["c"], ["dataset"]).select("dataset").distinct().count() == 3


def test_labels_other_than_0_and_1_raise(dirty):
    with pytest.raises(Exception, match="labels 0 and 1"):
        BM.auc(dirty.withColumn("label", F.col("label") + 1), "label", "score").collect()


def test_feature_without_values(dirty):
    df = dirty.withColumn("empty", F.lit(None).cast("double"))
    for exact in (False, True):
        out = P.numeric_by_class(df, ["value", "empty"], "label", exact=exact).where("feature = 'empty'")
        assert out.agg(F.sum("count")).first()[0] == 600
        assert P.numeric_by_value(df, ["value", "empty"], "label", exact=exact).where("feature = 'empty'").count() == 1
    later = df.withColumn("empty", F.rand(1))
    for exact in (False, True):
        drift = {r["feature"]: r["psi"] for r in D.psi(df, later, ["empty", "value"], exact=exact).collect()}
        assert drift["empty"] > 1 and drift["value"] < 0.01


def test_density_clusters_keep_rows_with_gaps(spark):
    df = spark.createDataFrame([(i, float(i % 3), 0.0 if i else None) for i in range(30)], "key long, x double, y double")
    out = {r["key"]: r["prediction"] for r in fit_dbscan(df, "key", ["x", "y"], 0.1, 3).collect()}
    assert len(out) == 30 and out[0] == -1 and out[1] >= 0


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, float(i % 40), float(i * 7 % 11), 1 + int(i % 40 >= 20)) for i in range(400)]
    return spark.createDataFrame(rows, "key long, x double, z double, target int")


def test_fit_on_a_target_of_1_and_2(separable):
    cfg = FitConfig(models=("decision_tree",), cross_validation="always", folds=3, attribution=True)
    result = fit_classifier(separable, "target", "key", cfg)
    roc = [r["value"] for r in result.metrics.where("metric = 'roc'").collect()]
    assert min(roc) > 0.99
    folds = result.cross_validation.collect()
    assert [r["model"] for r in folds] == ["decision_tree"] and folds[0]["mean"] > 0.95
    assert result.attribution.first()["feature"].startswith("x")


def test_trail_names_every_step(separable):
    wide = separable.withColumn("const_date", F.lit("2024-01-01")).withColumn("gap", F.lit(None).cast("double"))
    result = fit_classifier(wide, "target", "key", FitConfig(models=("decision_tree",), max_features=1))
    trail = {r["variable"]: (r["status"], r["drop_step"], r["selected"]) for r in result.trail.collect()}
    assert trail["x"] == ("kept", None, True) and trail["z"] == ("dropped", "selection", False)
    assert trail["gap"][:2] == ("dropped", "missing") and trail["const_date"][:2] == ("dropped", "dates")


def test_clusterer_options(separable):
    with pytest.raises(ValueError, match="no use"):
        fit_clusterer(separable.drop("target"), "key", FitConfig(tune="grid"))
    result = fit_clusterer(separable.drop("target").withColumn("gap", F.lit(None).cast("double")), "key", FitConfig(models=("kmeans",), cross_validation="always", folds=2), k_range=(2, 3))
    assert result.cross_validation.where("metric = 'silhouette'").count() == 1
    assert ("gap", "missing") in {(r["variable"], r["drop_step"]) for r in result.trail.collect()}


def test_search_limits(separable):
    ready = separable.select(F.col("key"), F.array("x", "z").alias("a"), (F.col("target") - 1).cast("double").alias("label"))
    from pyspark.ml.functions import array_to_vector
    ready = ready.select("key", array_to_vector("a").alias("features"), "label").cache()
    with pytest.raises(ValueError, match="max_grid"):
        tune.grid_search(ready, ready, "classification", "decision_tree", {"maxDepth": [2, 3, 4]}, max_grid=2)
    for n in (1, 3):
        best, model, table = tune.halving_search(ready, ready, "key", "classification", "decision_tree", n)
        again = tune.builder("classification", "decision_tree")(**best).fit(ready)
        assert model.toDebugString.split("\n", 1)[1] == again.toDebugString.split("\n", 1)[1]
    assert explain.shapley(ready, model, "key", ["x", "z"], permutations=1).select("key").distinct().count() == 400


def test_full_profile_has_every_section(spark, dirty):
    from featurelens.operators import correlate as C
    df = dirty.withColumn("twin", F.col("value") * 2 + F.col("key") % 2 * 0.1)
    whole = P.full_profile(df, ["value", "twin", "score"], "label")
    assert set(whole) == {"univariate", "quality", "bivariate", "correlation", "matrix", "ranking", "collinear"}
    want = {(r["feature1"], r["feature2"]): r["correlation"] for r in C.correlation_matrix(df, ["value", "twin", "score", "label"]).collect()}
    got = {(r["feature1"], r["feature2"]): r["correlation"] for r in whole["matrix"].collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert [(r["feature1"], r["feature2"]) for r in whole["collinear"].collect()] == [("twin", "value")]
    assert whole["quality"].first()["features"] == 3 and whole["ranking"].first()["feature"] == "score"
    by = P.full_profile(df, ["value", "twin"], "label", by=["dataset"])
    assert by["matrix"].count() == 27 and by["collinear"].count() == 3 and by["quality"].count() == 3
