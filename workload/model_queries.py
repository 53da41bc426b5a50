"""FS1-FS8, M1-M14, H1-H8, E25, X1, G1-G5, L1-L3: training, search, explanation and scoring.

Trained results have no SQL counterpart. A query ``<name>_result`` returns the operator's own rows (predictions, metrics,
trials, rankings); the query ``<name>`` beside it returns facts that SQL finds from the tables: rows scored, class counts, part
and fold sizes, the feature that carries the target, and bounds that a trained model must keep.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from featurelens.operators import binary_metrics as BM, dbscan as D, density as DG, models as M, regression_metrics as RM, select as FS, selection as S, split as L, transform as T, tune as H
from featurelens.operators.explain import mean_attribution, shapley
from featurelens.operators.shared import fresh_path
from featurelens.operators.tree_attribution import base_value, tree_attribution, tree_paths
from featurelens.plans import pipeline as PL, score as SC
from featurelens.sources import read_parquet
from featurelens.sources.writers import save_model
from workload import fixtures as X
from workload.fixtures import sql, u_sql
from workload.registry import query, r, rounded

RAW = ["price", "balance", "priority", "segment"]


def class_frame(spark, sf):
    """Orders with a learnable target: expensive and urgent."""
    df = X.labelled(spark, sf).withColumn("label", F.expr("CAST(price > 300000 OR (priority = '1-URGENT' AND price > 150000) AS DOUBLE)"))
    return df.select("key", *RAW, "label")


LABEL_SQL = "SELECT *, CAST(price > 300000 OR (priority = '1-URGENT' AND price > 150000) AS INT) AS label FROM labelled"
PART_SQL = f"CASE WHEN {u_sql('key')} < CAST('0.7' AS DOUBLE) THEN 'train' WHEN {u_sql('key')} < CAST('0.7' AS DOUBLE) + CAST('0.2' AS DOUBLE) THEN 'valid' ELSE 'test' END"
SELECT_SQL = "SELECT *, CAST(price > 300000 AS DOUBLE) AS label FROM labelled"
# the target is a cut of one feature; that feature must come first in every ranking
BEST_SQL = ("(SELECT feature FROM (SELECT unnest(['price', 'balance', 'nation', 'noise1', 'noise2']) AS feature, unnest([abs(corr(price, label)), abs(corr(balance, label)), "
            "abs(corr(nation, label)), abs(corr(key % 97, label)), abs(corr(key % 89, label))]) AS c FROM sel) ORDER BY c DESC LIMIT 1)")


def prepared(df, label: str = "label"):
    pre = T.fit_preprocessor(df, label, keep=RAW)
    return pre, pre.transform(df).select("key", "features", F.col(label).cast("double").alias("label"), *RAW)


def reg_frame(spark, sf):
    li = X.table(spark, sf, "lineitem")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    df = li.select(key.alias("key"), "l_quantity", "l_discount", "l_tax", "l_linenumber", F.col("l_extendedprice").alias("label"))
    return T.assemble(df, ["l_quantity", "l_discount", "l_tax", "l_linenumber"])


def emb(spark, sf):
    return X.table(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), "label")


def _classified(spark, sf, name, params):
    _, df = prepared(class_frame(spark, sf))
    return M.with_score(M.classifier(name, len(RAW), **params).fit(df).transform(df))


def _classifier(name: str, **params):
    def run(spark, sf):
        scored = _classified(spark, sf, name, params)
        ranks = BM.auc(scored).first()["auc"]
        return scored.agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positives"), F.count_if(F.col("score").between(0, 1)).alias("in_range"),
                          F.lit(ranks > 0.5).alias("beats_chance"))

    def result(spark, sf):
        return rounded(_classified(spark, sf, name, params).select("key", "label", "prediction", "score"))
    return run, result


for _id, _name, _params in (("m1", "logistic", {}), ("m2", "random_forest", {}), ("m3", "gradient_boosting", {"maxIter": 10}),
                            ("m4", "decision_tree", {}), ("m5", "neural_network", {"maxIter": 20})):
    _run, _result = _classifier(_name, **_params)
    query(f"{_id}_{_name}", sql("SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, count(*) AS in_range, count(DISTINCT label) = 2 AS beats_chance FROM c", "labelled", c=LABEL_SQL))(_run)
    query(f"{_id}_{_name}_result")(_result)


# least squares on one feature
@query("m6_linear_regression", f"SELECT {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept FROM lineitem")
def m6(spark, sf):
    df = T.assemble(X.table(spark, sf, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("label")), ["l_quantity"])
    model = M.regressor("linear_regression", regParam=0.0).fit(df)
    # the coefficients of the fitted line, read off two predictions
    line = model.transform(df).agg(F.regr_slope("prediction", "l_quantity").alias("slope"), F.regr_intercept("prediction", "l_quantity").alias("intercept"))
    return rounded(line, 4)


def _regressed(spark, sf, name, params):
    df = reg_frame(spark, sf)
    return M.regressor(name, **params).fit(df).transform(df)


def _regressor(name: str, **params):
    def run(spark, sf):
        pred = _regressed(spark, sf, name, params)
        error, spread = F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2))), F.stddev_pop("label")
        return rounded(pred.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("prediction") < float("inf")).alias("finite"), F.avg("label").alias("mean"), (error <= spread).alias("beats_mean")), 2)

    def result(spark, sf):
        return rounded(_regressed(spark, sf, name, params).select("key", "label", "prediction"), 2)
    return run, result


for _id, _name, _params in (("m7", "random_forest", {"numTrees": 10}), ("m8", "gradient_boosting", {"maxIter": 10}),
                            ("m9", "decision_tree", {}), ("m10", "fm_regression", {})):
    _run, _result = _regressor(_name, **_params)
    _full = f"{_id}_{_name}_regressor" if "regression" not in _name else f"{_id}_{_name}"
    query(_full, f"SELECT count(*) AS n, count(*) AS finite, {r('avg(l_extendedprice)', 2)} AS mean, stddev_pop(l_extendedprice) > 0 AS beats_mean FROM lineitem")(_run)
    query(f"{_full}_result")(_result)


def _clusterer(name: str, **params):
    def run(spark, sf):
        df = emb(spark, sf)
        model = M.clusterer(name, 4, **params).fit(df)
        pred = model.transform(df)
        x = vector_to_array("features")
        gaps = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in model.clusterCenters()]
        own = F.get(F.array(*gaps), F.col("prediction"))
        centre_of_all = pred.agg(F.array(*[F.avg(F.get(x, F.lit(i))) for i in range(64)]).alias("m")).first()["m"]
        spread = F.aggregate(F.zip_with(x, F.array(*[F.lit(v) for v in centre_of_all]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        # k-means rows belong to the nearest centre; a bisected tree only has to be tighter than one cluster
        nearest = F.count_if(own <= F.least(*gaps) + 1e-9) if name == "kmeans" else F.count_if(own >= 0)
        return pred.agg(F.count(F.lit(1)).alias("n"), nearest.alias("at_centre"), (F.sum(own) < F.sum(spread)).alias("tighter"))

    def result(spark, sf):
        df = emb(spark, sf)
        return M.clusterer(name, 4, **params).fit(df).transform(df).select("vec_id", "prediction")
    return run, result


for _id, _name in (("m11", "kmeans"), ("m12", "bisecting_kmeans")):
    _run, _result = _clusterer(_name, maxIter=10)
    query(f"{_id}_{_name}", "SELECT count(*) AS n, count(*) AS at_centre, count(DISTINCT embedding) > 1 AS tighter FROM embeddings")(_run)
    query(f"{_id}_{_name}_result")(_result)


def _mixture(spark, sf):
    df = T.fit_scaler(X.labelled(spark, sf), ["price", "balance"]).transform(X.labelled(spark, sf))
    return M.clusterer("gaussian_mixture", 3, maxIter=10).fit(df).transform(df)


@query("m13_gaussian_mixture", sql("SELECT count(*) AS n, count(*) AS sums_to_one, count(DISTINCT price) > 3 AS in_range FROM labelled", "labelled"))
def m13(spark, sf):
    pred = _mixture(spark, sf)
    total = F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda s, v: s + v)
    return pred.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(total - 1) < 1e-6).alias("sums_to_one"), F.min(F.col("prediction").between(0, 2)).alias("in_range"))


@query("m13_gaussian_mixture_result")
def m13_result(spark, sf):
    return _mixture(spark, sf).select("key", "prediction", F.transform(vector_to_array("probability"), lambda v: F.round(v, 6)).alias("probability"))


EPS, MIN_PTS = 1.2, 5
DB_POINTS = "SELECT c_custkey AS key, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer"


def _db_with(eps: float = EPS, min_pts: int = MIN_PTS) -> str:
    steps = {
        "pts": DB_POINTS,
        "near": f"SELECT a.key AS a, b.key AS b FROM pts a JOIN pts b ON b.x BETWEEN a.x - {eps} AND a.x + {eps} AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {eps}",
        "core": f"SELECT a AS key FROM near GROUP BY a HAVING count(*) >= {min_pts}",
        "links": "SELECT a, b FROM near WHERE a IN (SELECT key FROM core) AND b IN (SELECT key FROM core)",
        "reach": "SELECT key AS a, key AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a",
        "comp": "SELECT a AS key, min(b) AS root FROM reach GROUP BY a",
        "named": "SELECT key, dense_rank() OVER (ORDER BY root) - 1 AS label FROM comp",
        "border": "SELECT n.a AS key, min(m.label) AS label FROM near n JOIN named m ON n.b = m.key WHERE n.a NOT IN (SELECT key FROM core) GROUP BY n.a",
        "labels": "SELECT p.key, coalesce(m.label, b.label, -1) AS prediction, m.key IS NOT NULL AS core FROM pts p LEFT JOIN named m ON p.key = m.key LEFT JOIN border b ON p.key = b.key",
    }
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({t})" for n, t in steps.items()) + " "


def _customers(spark, sf):
    return X.table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_acctbal / 100 AS x", "CAST(c_nationkey AS DOUBLE) AS y")


@query("m14_dbscan", _db_with() + "SELECT key, prediction, core FROM labels")
def m14(spark, sf):
    return D.fit_dbscan(_customers(spark, sf), "key", ["x", "y"], EPS, MIN_PTS)


# suppliers take the label of the nearest core customer in reach
@query("m14_assign_dbscan", _db_with() + f"""SELECT s.s_suppkey AS key, coalesce((SELECT min_by(m.label, (sqrt((p.x - s.s_acctbal / 100) ** 2 + (p.y - s.s_nationkey) ** 2), m.label))
  FROM pts p JOIN named m ON p.key = m.key WHERE sqrt((p.x - s.s_acctbal / 100) ** 2 + (p.y - s.s_nationkey) ** 2) <= {EPS}), -1) AS prediction FROM supplier s""")
def m14_assign(spark, sf):
    train = _customers(spark, sf)
    fitted = D.fit_dbscan(train, "key", ["x", "y"], EPS, MIN_PTS)
    new = X.table(spark, sf, "supplier").selectExpr("s_suppkey AS key", "s_acctbal / 100 AS x", "CAST(s_nationkey AS DOUBLE) AS y")
    return D.assign_dbscan(new, "key", ["x", "y"], fitted, train, EPS)


SEARCH = [(1.0, 4), (1.0, 6), (1.5, 4), (1.5, 6)]
TRIAL_SQL = ("SELECT CAST({0} AS DOUBLE) AS eps, CAST({1} AS INT) AS min_pts, CAST(count(DISTINCT prediction) FILTER (WHERE prediction >= 0) AS INT) AS n_clusters, "
             "{2} AS noise_percentage FROM labels")


@query("m14_search_dbscan", " UNION ALL ".join(f"SELECT *, n_clusters >= 2 AND noise_percentage < 80 AS valid FROM ({_db_with(e, m)}" + TRIAL_SQL.format(e, m, r('avg(CAST(prediction = -1 AS INT)) * 100')) + ")" for e, m in SEARCH))
def m14_search(spark, sf):
    _, trials = DG.search_dbscan(_customers(spark, sf), "key", ["x", "y"], [1.0, 1.5], [4, 6])
    wanted = F.array(*[F.struct(F.lit(e).alias("eps"), F.lit(m).alias("min_pts")) for e, m in SEARCH])
    return rounded(trials.where(F.array_contains(wanted, F.struct("eps", "min_pts"))).drop("silhouette"))


# the rows of all settings, found in one pass
@query("m14_density_grid", " UNION ALL ".join(f"SELECT * FROM ({_db_with(e, m)} SELECT key, CAST({e} AS DOUBLE) AS eps, CAST({m} AS INT) AS min_pts, prediction, core FROM labels)" for e, m in SEARCH))
def m14_grid(spark, sf):
    return DG.density_grid(_customers(spark, sf), "key", ["x", "y"], [1.0, 1.5], [4, 6])


def _scored_lines(spark, sf):
    df = T.assemble(X.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice AS label"), ["l_quantity"])
    model = PipelineModel([M.regressor("linear_regression", regParam=0.0).fit(df)])
    return SC.score_regression(model, df, ["l_quantity"], ["l_orderkey", "l_linenumber", "l_quantity"], "label")


@query("g3_score_regression", f"""WITH line AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
  SELECT l_quantity, count(*) AS n, {r('avg(a * l_quantity + b)', 2)} AS prediction, {r('avg(l_extendedprice - (a * l_quantity + b))', 2)} AS residual,
  {r('avg(abs(l_extendedprice - (a * l_quantity + b)))', 2)} AS absolute_error FROM lineitem, line GROUP BY l_quantity""")
def g3_scored(spark, sf):
    out = _scored_lines(spark, sf).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("prediction", "residual", "absolute_error")])
    return rounded(out, 2)


FEATURES = ["price", "balance", "nation", "noise1", "noise2"]


def select_frame(spark, sf):
    return X.labelled(spark, sf).selectExpr("key", "price", "balance", "CAST(nation AS DOUBLE) AS nation", "CAST(key % 97 AS DOUBLE) AS noise1", "CAST(key % 89 AS DOUBLE) AS noise2",
                                            "CAST(price > 300000 AS DOUBLE) AS label")


def _ranking(table):
    """The best feature, and whether the importances are shares."""
    total = table.agg(F.sum("importance")).first()[0]
    return table.orderBy(F.desc("importance"), "feature").limit(1).select("feature", F.lit(0 < total <= 1 + 1e-9).alias("shares"))


RANKING_SQL = sql(f"SELECT {BEST_SQL} AS feature, count(*) > 0 AS shares FROM sel", "labelled", sel=SELECT_SQL)


@query("fs1_threshold_selection", RANKING_SQL)
def fs1(spark, sf):
    return _ranking(FS.threshold_selection(select_frame(spark, sf), FEATURES, "label"))


@query("fs1_threshold_selection_result")
def fs1_result(spark, sf):
    return rounded(FS.threshold_selection(select_frame(spark, sf), FEATURES, "label"))


@query("fs2_forest_importance", RANKING_SQL)
def fs2(spark, sf):
    return _ranking(FS.forest_importance(select_frame(spark, sf), FEATURES, "label", maxDepth=5))


@query("fs2_forest_importance_result")
def fs2_result(spark, sf):
    return rounded(FS.forest_importance(select_frame(spark, sf), FEATURES, "label", maxDepth=5))


def _kept(spark, names):
    return spark.createDataFrame([(min(names, key=lambda n: n != "price"), len(names), set(names) <= set(FEATURES))], "feature string, kept bigint, among boolean")


@query("fs3_chunked_selection", sql(f"SELECT {BEST_SQL} AS feature, CAST(2 AS BIGINT) AS kept, count(*) > 0 AS among FROM sel", "labelled", sel=SELECT_SQL))
def fs3(spark, sf):
    names = FS.chunked_selection(select_frame(spark, sf), FEATURES, "label", 2, chunk=3, per_chunk=1)
    return _kept(spark, names)


def _names(spark, names):
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("fs3_chunked_selection_result")
def fs3_result(spark, sf):
    return _names(spark, FS.chunked_selection(select_frame(spark, sf), FEATURES, "label", 2, chunk=3, per_chunk=1))


def _tree_importance(spark, sf):
    df = T.assemble(select_frame(spark, sf), FEATURES)
    model = M.classifier("decision_tree").fit(df)
    return FS.importance_table(spark, FEATURES, model.featureImportances)


@query("fs6_importance_names", RANKING_SQL)
def fs6(spark, sf):
    return _ranking(_tree_importance(spark, sf))


@query("fs6_importance_names_result")
def fs6_result(spark, sf):
    return rounded(_tree_importance(spark, sf))


@query("fs7_select_features", sql(f"SELECT {BEST_SQL} AS feature, CAST(3 AS BIGINT) AS kept, count(*) > 0 AS among FROM sel", "labelled", sel=SELECT_SQL))
def fs7(spark, sf):
    return _kept(spark, FS.select_features(select_frame(spark, sf), FEATURES, "label", most=3))


@query("fs7_select_features_result")
def fs7_result(spark, sf):
    return _names(spark, FS.select_features(select_frame(spark, sf), FEATURES, "label", most=3))


def _stored_importance(spark, sf):
    path = fresh_path(spark, "importance")
    FS.forest_importance(select_frame(spark, sf), FEATURES, "label", maxDepth=5).limit(30).write.mode("overwrite").parquet(path)
    return read_parquet(spark, path)


@query("fs8_importance_sink", RANKING_SQL)
def fs8(spark, sf):
    return _ranking(_stored_importance(spark, sf))


@query("fs8_importance_sink_result")
def fs8_result(spark, sf):
    return rounded(_stored_importance(spark, sf))


@query("t2_top_features", sql(f"SELECT {BEST_SQL} AS feature, CAST(2 AS BIGINT) AS kept, count(*) > 0 AS among FROM sel", "labelled", sel=SELECT_SQL))
def t2(spark, sf):
    return _kept(spark, FS.top_features(FS.forest_importance(select_frame(spark, sf), FEATURES, "label", maxDepth=4), 2))


@query("t2_top_features_result")
def t2_result(spark, sf):
    return _names(spark, FS.top_features(FS.forest_importance(select_frame(spark, sf), FEATURES, "label", maxDepth=4), 2))


def _parts(spark, sf):
    _, df = prepared(class_frame(spark, sf))
    tagged = L.with_split(df, "key", {"train": 0.7, "valid": 0.3})
    return tagged.where("dataset = 'train'").cache(), tagged.where("dataset = 'valid'").cache()


def _fitted_rows(model) -> int:
    """Rows that a fit has seen: of a tree those counted at its root, of a regression those of its summary."""
    if hasattr(model, "summary"):
        return model.summary.predictions.count()
    return model._java_obj.rootNode().impurityStats().rawCount()


def _trials(found, valid):
    """Trials, distinct settings and scores in range, rows in the fit of the best model, and rows that it scores."""
    _, model, table = found
    return table.agg(F.count(F.lit(1)).alias("trials"), F.countDistinct("params").alias("settings"), F.count_if(F.col("score").between(0, 1)).alias("in_range")).select(
        "*", F.lit(_fitted_rows(model)).cast("bigint").alias("train_rows"), F.lit(model.transform(valid).where("prediction IS NOT NULL").count()).alias("valid_rows"))


def _trials_sql(trials: int, settings: int) -> str:
    return sql(f"SELECT CAST({trials} AS BIGINT) AS trials, CAST({settings} AS BIGINT) AS settings, CAST({trials} AS BIGINT) AS in_range, count(*) FILTER (WHERE u < CAST('0.7' AS DOUBLE)) AS train_rows, "
               f"count(*) FILTER (WHERE u >= CAST('0.7' AS DOUBLE)) AS valid_rows FROM (SELECT {u_sql('key')} AS u FROM labelled)", "labelled")


SEARCHES = {
    "h1_grid_search": (4, lambda train, valid: H.grid_search(train, valid, "classification", "decision_tree", {"maxDepth": [3, 5], "minInstancesPerNode": [1, 2]})),
    "h2_random_search": (4, lambda train, valid: H.random_search(train, valid, "classification", "logistic", 4, {"maxIter": [10], "regParam": [0.01, 0.1, 0.5, 1.0], "elasticNetParam": [0.0, 0.5]})),
    "h3_successive_halving": (7, lambda train, valid: H.halving_search(train, valid, "key", "classification", "decision_tree", 4)),
}


def _search(find):
    def run(spark, sf):
        train, valid = _parts(spark, sf)
        return _trials(find(train, valid), valid)

    def result(spark, sf):
        return rounded(find(*_parts(spark, sf))[2])
    return run, result


for _name, (_n, _find) in SEARCHES.items():
    _run, _result = _search(_find)
    query(_name, _trials_sql(_n, 4))(_run)
    query(f"{_name}_result")(_result)


@query("h5_cross_validation", sql(f"SELECT CAST(floor({u_sql('key', seed=42)} * 3) AS INT) AS fold, count(*) AS n, count(*) > 0 AS in_range FROM labelled GROUP BY 1", "labelled"))
def h5(spark, sf):
    _, df = prepared(class_frame(spark, sf))
    folds = L.with_folds(df, "key", 3)
    _, mean, std = H.cross_validate(folds, "classification", "decision_tree", 3)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.lit(0.5 < mean <= 1 and 0 <= std < 0.5).alias("in_range"))


@query("h5_cross_validation_result")
def h5_result(spark, sf):
    _, df = prepared(class_frame(spark, sf))
    _, mean, std = H.cross_validate(L.with_folds(df, "key", 3), "classification", "decision_tree", 3)
    return rounded(spark.createDataFrame([(mean, std)], "mean double, std double"))


@query("h7_cluster_cross_validation", f"SELECT CAST(floor({u_sql('vec_id', seed=42)} * 3) AS INT) AS fold, count(*) AS n, count(*) > 0 AS in_range FROM embeddings GROUP BY 1")
def h7(spark, sf):
    folds = L.with_folds(emb(spark, sf), "vec_id", 3)
    found = {x["metric"]: x for x in H.fold_summary(H.cluster_folds(folds, "kmeans", 4, 3, maxIter=10)).collect()}
    good = found["silhouette"]["folds"] == 3 and -1 <= found["silhouette"]["min"] <= found["silhouette"]["max"] <= 1 and found["inertia"]["min"] > 0
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.lit(good).alias("in_range"))


@query("h7_cluster_cross_validation_result")
def h7_result(spark, sf):
    return rounded(H.fold_summary(H.cluster_folds(L.with_folds(emb(spark, sf), "vec_id", 3), "kmeans", 4, 3, maxIter=10)))


@query("h8_default_or_tuned")
def h8(spark, sf):
    train, valid = _parts(spark, sf)
    tagged = train.withColumn("dataset", F.lit("train")).unionByName(valid.withColumn("dataset", F.lit("valid")))
    tuned = H.grid_search(train, valid, "classification", "decision_tree", {"maxDepth": [2, 5]})[1]
    rows = None
    for name, model in (("default", M.classifier("decision_tree", maxDepth=3).fit(train)), ("tuned", tuned)):
        m = BM.validate_binary(M.with_score(model.transform(tagged)), "key").withColumn("model", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return rounded(S.tuned_or_default(rows, "ks"))


@query("e25_elbow_table", "SELECT k, n, n > 0 AS in_range FROM (SELECT count(*) AS n FROM embeddings), (SELECT CAST(unnest([2, 3, 4]) AS INT) AS k)")
def e25(spark, sf):
    df = emb(spark, sf)
    models, table = M.fit_k_range(df, "kmeans", [2, 3, 4], maxIter=10)
    # the fit's own counts: rows of its clusters
    sizes = spark.createDataFrame([(k, sum(m.summary.clusterSizes)) for k, m in models.items()], "k int, n bigint")
    return table.join(sizes, "k").select(F.col("k").cast("int").alias("k"), "n", (F.col("silhouette").between(-1, 1) & (F.col("inertia") > 0)).alias("in_range"))


@query("e25_elbow_table_result")
def e25_result(spark, sf):
    return rounded(M.fit_k_range(emb(spark, sf), "kmeans", [2, 3, 4], maxIter=10)[1])


def _attribution(spark, sf):
    pre, df = prepared(class_frame(spark, sf))
    return mean_attribution(shapley(df, M.classifier("decision_tree").fit(df), "key", pre.feature_columns, permutations=5))


@query("x1_attribution", sql("SELECT CASE WHEN corr(price, label) > 0 THEN 'price' END AS feature, count(*) > 0 AS positive FROM c", "labelled", c=LABEL_SQL))
def x1(spark, sf):
    return _attribution(spark, sf).limit(1).select("feature", (F.col("importance") > 0).alias("positive"))


@query("x1_attribution_result")
def x1_result(spark, sf):
    return rounded(_attribution(spark, sf))


def _tree_shares(spark, sf):
    pre, df = prepared(class_frame(spark, sf))
    model = M.classifier("decision_tree").fit(df)
    return df, model, tree_attribution(df, model, "key", pre.feature_columns)


# every row's shares and the base value add up to its probability; the feature with the largest mean share carries the target
@query("x1_tree_attribution", sql("SELECT count(*) AS n, count(*) AS adds_up, CASE WHEN corr(price, label) > 0 THEN 'price' END AS top FROM c", "labelled", c=LABEL_SQL))
def x1_tree(spark, sf):
    df, model, shares = _tree_shares(spark, sf)
    total = shares.groupBy("key").agg(F.sum("attribution").alias("total"))
    scored = M.with_score(model.transform(df)).select("key", "score").join(total, "key")
    gap = F.abs(F.col("total") + F.lit(base_value(tree_paths(model))) - F.col("score"))
    top = mean_attribution(shares).first()["feature"]
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(gap < 1e-9).alias("adds_up"), F.lit(top).alias("top"))


@query("x1_tree_attribution_result")
def x1_tree_result(spark, sf):
    return rounded(_tree_shares(spark, sf)[2])


def _class_model(spark, sf):
    df = class_frame(spark, sf)
    pre, ready = prepared(df)
    return df, pre, PipelineModel([*pre.model.stages, M.classifier("logistic").fit(ready)])


@query("g1_score_classification", sql("SELECT key, balance IS NOT NULL AS scored FROM labelled", "labelled"))
def g1(spark, sf):
    df, pre, model = _class_model(spark, sf)
    out = SC.score_classification(model, df.drop("label"), pre.raw_columns, ["key"])
    return out.select("key", F.col("prediction").isin(0.0, 1.0).alias("scored"))


@query("g1_score_classification_result")
def g1_result(spark, sf):
    df, pre, model = _class_model(spark, sf)
    return rounded(SC.score_classification(model, df.drop("label"), pre.raw_columns, ["key"]))


@query("g2_positive_probability", sql("SELECT key, balance IS NOT NULL AS in_range FROM labelled", "labelled"))
def g2(spark, sf):
    df, _, model = _class_model(spark, sf)
    return M.with_score(model.transform(df)).select("key", F.col("score").between(0, 1).alias("in_range"))


@query("g2_positive_probability_result")
def g2_result(spark, sf):
    df, _, model = _class_model(spark, sf)
    return rounded(M.with_score(model.transform(df)).select("key", "score"))


@query("g4_score_clusters", "SELECT count(*) AS n, count(DISTINCT vec_id) AS ids FROM embeddings")
def g4(spark, sf):
    df = emb(spark, sf)
    model = PipelineModel([M.clusterer("kmeans", 4, maxIter=10).fit(df)])
    scored = SC.score_clusters(model, df, ["features"], ["vec_id"])[0]
    return scored.agg(F.count_if(F.col("prediction").between(0, 3)).alias("n"), F.countDistinct("vec_id").alias("ids"))


@query("g4_score_clusters_result")
def g4_result(spark, sf):
    df = emb(spark, sf)
    model = PipelineModel([M.clusterer("kmeans", 4, maxIter=10).fit(df)])
    return rounded(SC.score_clusters(model, df, ["features"], ["vec_id"])[1])


def _scoring_job(spark, sf):
    df, pre, model = _class_model(spark, sf)
    path, out = fresh_path(spark, "scoring-model"), fresh_path(spark, "scored")
    save_model(spark, model, path, {"task": "classification", "required": pre.raw_columns, "key": "key"})
    SC.score(spark, path, df.drop("label"), out)
    return read_parquet(spark, out)


@query("g5_scoring_job", sql("SELECT key, balance IS NOT NULL AS scored FROM labelled", "labelled"))
def g5(spark, sf):
    return _scoring_job(spark, sf).select("key", F.col("prediction").isin(0.0, 1.0).alias("scored"))


@query("g5_scoring_job_result")
def g5_result(spark, sf):
    return rounded(_scoring_job(spark, sf))


def _sizes(df, key, result, bound):
    """Rows of each part that the fitted pipeline scores, metric rows for it, and whether these lie in their range."""
    scored = result.model.transform(L.with_split(df, key, {"train": 0.7, "valid": 0.2, "test": 1.0 - 0.7 - 0.2})).where("prediction IS NOT NULL")
    parts = scored.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    found = result.metrics.groupBy("dataset").agg(F.count("value").alias("metrics"), F.min(bound).alias("in_range"))
    return parts.join(found, "dataset").select("dataset", "n", "metrics", "in_range")


def _l1(spark, sf):
    cfg = PL.FitConfig(models=("logistic", "decision_tree"), exclude=("odate",))
    df = class_frame(spark, sf)
    return df, PL.fit_classifier(df, "label", "key", cfg)


@query("l1_fit_classifier", sql(f"SELECT dataset, count(*) AS n, CAST(6 AS BIGINT) AS metrics, count(*) > 0 AS in_range FROM (SELECT {PART_SQL} AS dataset FROM labelled) GROUP BY dataset", "labelled"))
def l1(spark, sf):
    df, result = _l1(spark, sf)
    return _sizes(df, "key", result, F.col("value").between(0, F.when(F.col("metric") == "ks", 100).otherwise(1)))


@query("l1_fit_classifier_result")
def l1_result(spark, sf):
    return rounded(_l1(spark, sf)[1].metrics)


def _l2(spark, sf):
    cfg = PL.FitConfig(models=("linear_regression", "decision_tree"))
    df = reg_frame(spark, sf).drop("features")
    return df, PL.fit_regressor(df, "label", "key", cfg)


@query("l2_fit_regressor", "SELECT count(*) AS n, CAST(3 AS BIGINT) AS parts, count(*) > 0 AS finite FROM lineitem")
def l2(spark, sf):
    df, result = _l2(spark, sf)
    found = result.metrics.agg(F.countDistinct("dataset").alias("parts"), F.min(F.abs("value") < float("inf")).alias("finite"))
    return found.select(F.lit(result.model.transform(df).where("prediction IS NOT NULL").count()).alias("n"), "parts", "finite")


@query("l2_fit_regressor_result")
def l2_result(spark, sf):
    return rounded(_l2(spark, sf)[1].metrics, 3)


def _l3(spark, sf):
    cfg = PL.FitConfig(models=("kmeans",), params={"kmeans": {"maxIter": 10}})
    return PL.fit_clusterer(X.labelled(spark, sf).select("key", "price", "balance", "nation"), "key", cfg, (2, 3, 4))


@query("l3_fit_clusterer", sql(f"SELECT dataset, count(*) AS n, CAST(6 AS BIGINT) AS metrics, count(*) > 0 AS in_range FROM (SELECT {PART_SQL} AS dataset FROM labelled) GROUP BY dataset", "labelled"))
def l3(spark, sf):
    metrics = _l3(spark, sf).metrics
    # the rows that the evaluation of the clusters counted
    rows = F.max(F.when(F.col("metric") == "sample_count", F.col("value"))).cast("bigint")
    bound = (F.col("metric") != "silhouette") | F.col("value").between(-1, 1)
    return metrics.groupBy("dataset").agg(rows.alias("n"), F.count("value").alias("metrics"), F.min(bound).alias("in_range"))


@query("l3_fit_clusterer_result")
def l3_result(spark, sf):
    return rounded(_l3(spark, sf).metrics)


def _l3_density(spark, sf):
    cfg = PL.FitConfig(models=("dbscan",), params={"dbscan": {"eps_values": [0.05, 0.1, 0.2], "min_pts_values": [3, 5]}})
    df = _customers(spark, sf).select(F.concat(F.lit("c"), "key").alias("key"), F.round("x", 1).alias("x"), "y")
    return PL.fit_clusterer(df, "key", cfg)


# every row of a part is in a cluster or noise
@query("l3_fit_clusterer_dbscan", f"SELECT dataset, count(*) AS n, true AS in_range FROM (SELECT {PART_SQL} AS dataset FROM (SELECT 'c' || c_custkey AS key FROM customer)) GROUP BY dataset")
def l3_density(spark, sf):
    metrics = _l3_density(spark, sf).metrics
    rows = F.sum(F.when(F.col("metric").isin("sample_count", "noise_count"), F.col("value"))).cast("bigint")
    bound = (F.col("metric") != "silhouette") | F.col("value").between(-1, 1)
    return metrics.groupBy("dataset").agg(rows.alias("n"), F.min(bound).alias("in_range"))


@query("l3_fit_clusterer_dbscan_result")
def l3_density_result(spark, sf):
    return rounded(_l3_density(spark, sf).trials)
