import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featurelens.operators import binary_metrics as BM, cluster_metrics as CM, regression_metrics as RM, selection as S


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 2000)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    return spark.createDataFrame([(int(i), int(a), float(b), int(b > 0.5)) for i, (a, b) in enumerate(zip(y, s))],
                                 "key bigint, label int, score double, prediction int").repartition(3)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 7])
def test_auc_equals_the_evaluator(scored, rows_per_task):
    got = BM.auc(scored, rows_per_task=rows_per_task).first()["auc"]
    want = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(scored.withColumn("label", F.col("label").cast("double")))
    assert got == pytest.approx(want, abs=1e-9)
    turned = scored.withColumn("score", -F.col("score"))
    assert BM.auc(turned).first()["auc"] == pytest.approx(1 - got, abs=1e-9)


def test_one_class_has_no_auc(scored):
    one = scored.where("label = 1")
    assert BM.auc(one).first()["auc"] is None
    assert BM.decile_table(one, "label", "score", "key").where("spread IS NOT NULL").count() == 0


def test_deciles_are_complete_for_few_rows(scored):
    few = scored.limit(7)
    d = BM.decile_table(few, "label", "score", "key")
    assert d.count() == 7 and d.agg(F.sum("count")).first()[0] == 7


def test_weighted_scores_equal_the_evaluator(scored):
    df = scored.select((F.col("key") % 3).cast("double").alias("label"), (F.col("key") * 7 % 5 % 3).cast("double").alias("prediction"))
    got = BM.weighted_scores(BM.confusion(df)).first().asDict()
    for ours, theirs in (("accuracy", "accuracy"), ("f1", "f1"), ("precision", "weightedPrecision"), ("recall", "weightedRecall")):
        assert got[ours] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df), abs=1e-9)


def test_thinned_roc_keeps_the_end(scored):
    pts = BM.roc_points(scored, points=10).orderBy("fpr", "tpr").collect()
    assert len(pts) <= 12 and (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)


def test_regression_metrics_equal_the_evaluator(scored):
    df = scored.select(F.col("score").alias("y"), (F.col("score") * 0.8 + 0.1).alias("prediction"))
    got = RM.basic_metrics(df, "y").first().asDict()
    for m in ("rmse", "mae", "r2", "mse"):
        assert got[m] == pytest.approx(RegressionEvaluator(labelCol="y", metricName=m).evaluate(df), abs=1e-9)
    rows = {r["metric"]: r["value"] for r in RM.validate_regression(df.withColumn("dataset", F.lit("a")), "y", exact=True).collect()}
    assert rows["explained_variance"] == pytest.approx(0.96, abs=1e-9)


def test_unusable_predictions_are_dropped_and_constants_do_not_fail(spark):
    df = spark.createDataFrame([(1.0, 1.0), (None, 2.0), (3.0, float("nan")), (1.0, 1.0)], "y double, prediction double").withColumn("dataset", F.lit("a"))
    rows = {r["metric"]: r["value"] for r in RM.validate_regression(df, "y").collect()}
    assert rows["rmse"] == 0.0 and rows["r2"] is None
    ok = df.where("y = 1 AND prediction = 1")
    assert RM.residual_histogram(ok, "y").count() == 1 and RM.residual_trend(ok, "y").first()["slope"] is None
    assert RM.qq_fit(RM.qq_table(ok, "y", exact=True)).first()["qq_r2"] is None


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(3 * c, 1, 3)], c) for i, c in enumerate(rng.integers(0, 3, 400).tolist())]
    return spark.createDataFrame(rows, "id bigint, features array<double>, prediction int").repartition(3)


def test_silhouette_equals_the_evaluator_and_brute_force(blobs):
    got = CM.silhouette(blobs).first()["silhouette"]
    assert got == pytest.approx(ClusteringEvaluator().evaluate(blobs.withColumn("features", array_to_vector("features"))), abs=1e-9)
    rows = blobs.collect()
    x, c = np.array([r["features"] for r in rows]), np.array([r["prediction"] for r in rows])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    sil = []
    for i in range(len(x)):
        mean = {k: d2[i, c == k].sum() / ((c == k).sum() - (k == c[i])) for k in set(c)}
        a, b = mean[c[i]], min(v for k, v in mean.items() if k != c[i])
        sil.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(sil), abs=1e-9)


def test_cluster_table_and_single_cluster(blobs):
    all_ = CM.evaluate_clusters(blobs).first()
    assert all_["num_clusters"] == 3 and all_["inertia"] == pytest.approx(CM.inertia(blobs).first()["inertia"])
    assert all_["davies_bouldin"] == pytest.approx(CM.davies_bouldin(blobs).first()["davies_bouldin"])
    one = CM.evaluate_clusters(blobs.withColumn("prediction", F.lit(0))).first()
    assert one["silhouette"] == -1.0 and one["davies_bouldin"] is None and one["calinski_harabasz"] is None


@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_centre_comparisons_in_chunks_equal_numpy(spark, monkeypatch, chunk):
    monkeypatch.setattr(CM, "CENTRES", chunk)
    rng = np.random.default_rng(8)
    rows = [(g, c, [float(v) for v in rng.normal(5 * c, 1, 2)]) for g, k in (("a", 7), (None, 3), ("one", 1)) for c in range(k) for _ in range(12)]
    df = spark.createDataFrame(rows, "dataset string, prediction int, features array<double>")
    got = {r["dataset"]: r for r in CM.evaluate_clusters(df, by=["dataset"]).collect()}
    apart = {r["dataset"]: r for r in CM.centre_distances(df, by=["dataset"]).collect()}
    davies = {r["dataset"]: r["davies_bouldin"] for r in CM.davies_bouldin(df, by=["dataset"]).collect()}
    assert set(got) == set(apart) == set(davies) == {"a", None, "one"}
    for g, k in (("a", 7), (None, 3)):
        own = [np.array([x for h, c, x in rows if h == g and c == i]) for i in range(k)]
        centre = np.array([x.mean(axis=0) for x in own])
        s = np.array([np.linalg.norm(x - m, axis=1).mean() for x, m in zip(own, centre)])
        d = np.linalg.norm(centre[:, None] - centre[None], axis=2)
        pairs = d[np.triu_indices(k, 1)]
        worst = [max((s[i] + s[j]) / d[i, j] for j in range(k) if j != i) for i in range(k)]
        for found in (got[g], apart[g]):
            assert [found[f"{n}_inter_cluster_distance"] for n in ("min", "max", "mean")] == pytest.approx([pairs.min(), pairs.max(), pairs.mean()])
        assert got[g]["davies_bouldin"] == pytest.approx(np.mean(worst)) and davies[g] == pytest.approx(np.mean(worst))
    assert got["one"]["davies_bouldin"] is None and davies["one"] is None and got["one"]["mean_inter_cluster_distance"] is None


def test_pca_equals_numpy(blobs):
    out, shares = CM.project_2d(blobs, keep=["id"])
    x = np.array([r["features"] for r in blobs.orderBy("id").collect()])
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert shares == pytest.approx(list(w[:2] / w.sum()), abs=1e-9)
    assert out.agg(F.variance("pc1")).first()[0] == pytest.approx(w[0])


def test_elbow_needs_three_k(spark):
    t = spark.createDataFrame([(2, 10.0, 0.2, 1.0, 1.0), (3, 5.0, 0.4, 2.0, 0.5)], "k int, inertia double, silhouette double, calinski_harabasz double, davies_bouldin double")
    assert CM.find_elbow(t).count() == 0
    assert S.choose_k(t).first()["best_k"] == 3
    more = t.unionByName(spark.createDataFrame([(4, 4.5, 0.3, 1.5, 0.7)], t.schema))
    assert CM.find_elbow(more).first()["elbow_k"] == 3
    assert {r["criterion"]: r["k"] for r in CM.recommend_k(more).collect()} == {"elbow": 3, "silhouette": 3, "calinski_harabasz": 3, "davies_bouldin": 3}


@pytest.fixture(scope="module")
def metric_rows(spark):
    rows = [("a", "train", "ks", 50.0), ("a", "valid", "ks", 45.0), ("a", "test", "ks", 40.0), ("b", "train", "ks", 40.0), ("b", "valid", "ks", 39.0), ("b", "test", "ks", 38.0),
            ("c", "train", "ks", 41.0), ("c", "valid", "ks", 40.0), ("c", "test", "ks", 41.0)]
    return spark.createDataFrame(rows, "model string, dataset string, metric string, value double")


def test_champion_is_stable_before_strong(metric_rows):
    r = {x["role"]: x["model"] for x in S.champion_classification(metric_rows).collect()}
    assert r["Champion"] == "c" and r["Challenger"] == "b"
    with pytest.raises(ValueError):
        S.champion_classification(metric_rows, dataset="none")
    assert S.usable_metric(metric_rows, "roc", "valid", S.CLASS_FALLBACK) == "ks"


def test_regression_champion_uses_the_direction_of_the_metric(metric_rows):
    rows = metric_rows.withColumn("metric", F.lit("rmse")).withColumn("value", F.col("value") / 1000)
    assert S.champion_regression(rows).where("rank = 1").first()["model"] == "b"


def test_davies_bouldin_prefers_the_lower_score(spark):
    s = spark.createDataFrame([("a", "train", 0.9), ("a", "validation", 0.8), ("b", "train", 0.5), ("c", "cv", None)], "model string, source string, value double")
    assert S.best_clustering(s, "davies_bouldin").first()["best_model"] == "b"
    assert S.best_clustering(s, "silhouette").first()["best_score"] == 0.8


def test_tuned_rules(spark):
    def rows(*v):
        return spark.createDataFrame([("default", "train", "roc", v[0]), ("default", "valid", "roc", v[1]), ("tuned", "train", "roc", v[2]), ("tuned", "valid", "roc", v[3])],
                                     "model string, dataset string, metric string, value double")
    pick = lambda *v: S.tuned_or_default(rows(*v), "roc").first()["reason"]
    assert pick(0.8, 0.8, 0.85, 0.85) == "improved" and pick(0.8, 0.8, 0.8, 0.79) == "not better"
    assert pick(0.8, 0.8, 0.8, 0.803) == "improvement below threshold" and pick(0.8, 0.8, 0.95, 0.85) == "more overfitting"
