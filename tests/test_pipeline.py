import pytest
from pyspark.sql import functions as F

from featurelens import sources as S
from featurelens.operators import models as M, select as FS, split as L, transform as T, tune as H
from featurelens.operators.explain import mean_attribution, shapley
from featurelens.plans import pipeline as PL, score as SC


@pytest.fixture(scope="module")
def flowers(spark):
    """Three classes of different size, told apart by two numbers and a text."""
    return spark.range(600).select(
        F.col("id").alias("key"), (F.col("id") % 6).cast("double").alias("width"), (F.sin("id") + F.col("id") % 6).alias("length"),
        F.when(F.col("id") % 6 < 2, "red").when(F.col("id") % 7 == 0, " ").otherwise("blue").alias("colour"),
        F.when(F.col("id") % 6 < 2, "small").when(F.col("id") % 6 < 5, "middle").otherwise("large").alias("kind"))


def test_split_is_complete_disjoint_and_stable(spark, flowers):
    parts = L.train_valid_test(flowers, "key")
    assert sum(p.count() for p in parts.values()) == 600
    again = L.train_valid_test(flowers.repartition(17), "key")
    assert all(parts[n].exceptAll(again[n]).count() == 0 for n in parts)
    folds = {r["fold"]: r["count"] for r in L.with_folds(flowers, "key", 5).groupBy("fold").count().collect()}
    assert set(folds) == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError):
        L.with_split(flowers, "key", {"a": 0.8, "b": 0.4})


def test_large_table_fractions():
    assert L.large_table_fraction(5_000_000) == 1.0
    assert L.large_table_fraction(6_000_000) == 500_000 / 6_000_000
    assert L.large_table_fraction(100_000_000) == 0.01
    assert L.large_table_fraction(2_000_000, "regression") == 0.05
    assert H.use_cross_validation("auto", 10_000, True) is False and H.use_cross_validation("auto", 100, True) and H.use_cross_validation("auto", 10_000, False)
    assert M.hidden_units(10) == 8 and M.hidden_units(20) == 16 and M.hidden_units(21) == 32
    assert FS.forest_size(10) == (10, 10) and FS.forest_size(400) == (6, 3)


def test_preprocessing_learns_from_train_only(flowers):
    train = flowers.where("colour <> 'blue'")
    pre = T.fit_preprocessor(train, "kind", exclude=["key"])
    out = T.encoded_frame(pre, flowers, ["key"])
    codes = {r["colour"]: r["c"] for r in out.join(flowers.select("key", "colour"), "key").groupBy("colour").agg(F.max("colour_encoded").alias("c")).collect()}
    assert codes == {"red": 0.0, "blue": 1.0, " ": 1.0}
    with pytest.raises(ValueError):
        T.prepare_later_data(pre, flowers.drop("width"))
    with pytest.raises(ValueError):
        T.prepare_later_data(pre, flowers.drop("kind"))


def test_multiclass_fit_saves_and_scores_text_labels(spark, flowers, tmp_path):
    later = {"oot1": flowers.where("key % 2 = 0")}
    cfg = PL.FitConfig(models=("decision_tree", "gradient_boosting", "logistic"), profile=True)
    res = PL.fit_classifier(flowers, "kind", "key", cfg, later)
    assert {r["model"] for r in res.metrics.select("model").distinct().collect()} == {"decision_tree", "logistic"}
    assert {r["dataset"] for r in res.metrics.select("dataset").distinct().collect()} == {"train", "valid", "test", "oot1"}
    assert set(res.profile) == {"univariate", "quality", "bivariate", "correlation", "matrix", "ranking", "collinear"}
    res.save(str(tmp_path / "m"))
    SC.score(spark, str(tmp_path / "m"), flowers.drop("kind"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).join(flowers, "key")
    assert got.count() == 600 and got.where("predicted_kind = kind").count() > 550
    with pytest.raises(ValueError):
        SC.score(spark, str(tmp_path / "m"), flowers.drop("width"), str(tmp_path / "out2"))


@pytest.mark.parametrize("method", ["oversample", "smote"])
def test_rare_class_is_balanced_and_tuning_runs(flowers, method):
    df = flowers.withColumn("rare", (F.col("key") % 40 == 0).cast("int")).withColumn("width", F.when(F.col("rare") == 1, F.lit(9.0) + F.col("key") % 3).otherwise(F.col("width"))).drop("kind")
    cfg = PL.FitConfig(models=("decision_tree",), auto_balance=True, balance_ratio=0.3, balance_method=method, tune="grid" if method == "oversample" else "")
    res = PL.fit_classifier(df, "rare", "key", cfg)
    roc = res.metrics.where("metric = 'roc' AND dataset = 'train'").first()["value"]
    assert roc > 0.9 and res.best == "decision_tree"


def test_single_class_is_an_error(flowers):
    with pytest.raises(ValueError):
        PL.fit_classifier(flowers.withColumn("one", F.lit(1)), "one", "key")


def test_regression_fit(flowers):
    res = PL.fit_regressor(flowers.drop("kind"), "length", "key", PL.FitConfig(models=("linear_regression", "decision_tree")))
    assert res.ranking.where("rank = 1").count() == 1
    scored = SC.score_regression(res.model, flowers, res.preprocessor.raw_columns, ["key"], "length")
    assert scored.where("abs(residual) <> absolute_error").count() == 0 and scored.count() == 600


def test_clustering_fit(flowers):
    res = PL.fit_clusterer(flowers.drop("kind"), "key", PL.FitConfig(models=("kmeans",), profile=True), (2, 3, 4))
    assert res.best == "kmeans" and "numeric" in res.profile
    assert SC.score_clusters(res.model, flowers, res.preprocessor.raw_columns, ["key"])[0].count() == 600


def test_clustering_fit_with_density(flowers, tmp_path):
    cfg = PL.FitConfig(models=("kmeans", "dbscan"), params={"dbscan": {"eps_values": [0.3, 0.6], "min_pts_values": [4, 8]}}, cross_validation="always", folds=2, profile=True)
    res = PL.fit_clusterer(flowers.drop("kind"), "key", cfg, (2, 3))
    assert res.trials.count() >= 4 and "sizes" in res.profile
    held = res.metrics.where("model = 'dbscan' AND metric IN ('sample_count', 'noise_count')").agg(F.sum("value")).first()[0]
    assert held == 600
    assert {r["model"] for r in res.cross_validation.collect()} == {"kmeans", "dbscan"}
    only = PL.fit_clusterer(flowers.drop("kind"), "key", PL.FitConfig(models=("dbscan",), params={"dbscan": {"eps": 0.5, "min_pts": 4}}))
    assert only.best == "dbscan" and only.trials is None
    only.save(str(tmp_path / "m"))
    SC.score(flowers.sparkSession, str(tmp_path / "m"), flowers, str(tmp_path / "out"))
    assert flowers.sparkSession.read.parquet(str(tmp_path / "out")).count() == 600


def test_attributions_sum_to_the_change_of_the_output(flowers):
    df = T.assemble(flowers.withColumn("label", F.col("width") * 2 + F.col("length")), ["width", "length"])
    model = M.regressor("linear_regression", regParam=0.0).fit(df)
    values = shapley(df, model, "key", ["width", "length"], max_rows=20, permutations=3)
    assert values.count() == 40
    mean = df.agg(F.avg("width").alias("w"), F.avg("length").alias("l")).first()
    both = values.groupBy("key").agg(F.sum("attribution").alias("s")).join(df, "key").select((F.col("s") - (F.col("label") - 2 * mean["w"] - mean["l"])).alias("d"))
    assert both.agg(F.max(F.abs("d"))).first()[0] < 1e-6
    assert mean_attribution(values).count() == 2


def test_selection_rules(flowers):
    df = flowers.withColumn("y", F.col("width") > 2).select(F.col("y").cast("double").alias("y"), "width", "length", *[F.lit(1.0).alias(f"c{i}") for i in range(6)])
    names = df.columns[1:]
    assert FS.chunked_selection(df, names, "y", 2, chunk=3, per_chunk=1)[0] in ("width", "length")
    # a pass that removes nothing ends with one ranking
    assert len(FS.chunked_selection(df, names, "y", 3, chunk=2, per_chunk=2)) == 3
    assert {r["feature"] for r in FS.statistical_selection(df, names, "y", 5).collect()} == {"width", "length"}
    assert FS.select_features(df, ["width"], "y") == ["width"]


def test_halving_ends_on_all_rows(flowers):
    df = T.assemble(flowers.withColumn("label", (F.col("width") > 2).cast("double")), ["width", "length"])
    p, model, trials = H.halving_search(df, df, "key", "classification", "decision_tree", 4)
    assert trials.agg(F.max("fraction")).first()[0] in (0.5, 1.0) and p["maxDepth"] in (3, 5)


def test_unknown_names_are_errors(flowers):
    for call in (lambda: M.classifier("none"), lambda: M.regressor("none"), lambda: M.clusterer("none", 2), lambda: M.classifier("gradient_boosting", classes=3),
                 lambda: S.load_source(flowers.sparkSession, "nothing")):
        with pytest.raises(ValueError):
            call()


def test_text_files_round_trip(spark, flowers, tmp_path):
    flowers.write.option("header", True).option("sep", "\t").csv(str(tmp_path / "t.tsv"))
    df, info = S.load_source(spark, str(tmp_path / "t.tsv"))
    assert info["format"] == "tsv" and df.count() == 600 and dict(df.dtypes)["width"] == "double"
    (tmp_path / "j.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert S.read_json(spark, str(tmp_path / "j.json"), multi_line=True).count() == 2
    with pytest.raises(ValueError):
        S.load_datasets(spark, {"train": flowers, "oot1": flowers.drop("width")})


def test_working_sample_is_free_of_the_partitioning(flowers):
    ids = lambda df: sorted(r["key"] for r in S.working_sample(df, "key", 0.5).select("key").collect())
    assert ids(flowers) == ids(flowers.repartition(7)) and 200 < len(ids(flowers)) < 400
    assert S.working_sample(flowers, "key", 1.0).count() == 600

def test_reload_strips_suffixes(flowers):
    assert S.reload_selected(flowers, ["colour_encoded", "width"], "kind", "width > 1").columns == ["kind", "colour", "width"]
