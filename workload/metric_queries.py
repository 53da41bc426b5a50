"""Ordering and metrics of scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import binary_metrics as BM, ordering as O, regression_metrics as RM
from featurelens.plans.score import with_residuals
from workload import fixtures as X
from workload.fixtures import sql, u_sql
from workload.registry import query, r, rounded

DS = ["dataset"]
ORDER = "PARTITION BY dataset ORDER BY score DESC, u, key"


@query("w1_row_number", sql(f"SELECT dataset, key, row_number() OVER ({ORDER}) AS row_number FROM scored", "scored"))
def w1(spark, sf):
    return O.row_numbers(X.scored(spark, sf), "score", ["key"], DS, rows_per_task=5_000).select("dataset", "key", "row_number")


@query("w2_deciles", sql(f"SELECT dataset, key, ntile(10) OVER ({ORDER}) AS decile FROM scored", "scored"))
def w2(spark, sf):
    return O.ntiles(X.scored(spark, sf), "score", ["key"], DS).select("dataset", "key", "decile")


# a tile from cut points differs from the exact one only by rows at the cuts
@query("w2_approximate_deciles", "SELECT count(*) AS n, 10 AS tiles, true AS near FROM orders")
def w2_approximate(spark, sf):
    orders = X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    exact = O.ntiles(orders, "o_totalprice", ["o_orderkey"]).select("o_orderkey", F.col("decile").alias("exact"))
    both = O.approximate_ntiles(orders, "o_totalprice").join(exact, "o_orderkey")
    apart = F.abs(F.col("decile") - F.col("exact"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("decile").cast("int").alias("tiles"), ((F.max(apart) <= 1) & (F.avg(apart) < 0.01)).alias("near"))


DECILE = f"""SELECT dataset, decile, count(*) AS count, sum(label) AS target, sum(1 - label) AS non_target FROM
  (SELECT *, ntile(10) OVER ({ORDER}) AS decile FROM scored) GROUP BY dataset, decile"""
CUM = """SELECT *, sum(target) OVER w AS cum_target, sum(non_target) OVER w AS cum_non_target, sum(target) OVER (PARTITION BY dataset) AS tt,
  sum(non_target) OVER (PARTITION BY dataset) AS nt FROM dec WINDOW w AS (PARTITION BY dataset ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query("w3_running_totals", sql("SELECT dataset, decile, cum_target, cum_non_target FROM cum", "scored", dec=DECILE, cum=CUM))
def w3(spark, sf):
    t = O.ntiles(X.scored(spark, sf), "score", ["key"], DS)
    agg = t.groupBy("dataset", "decile").agg(F.sum("label").alias("target"), F.sum(1 - F.col("label")).alias("non_target"))
    return O.cumulative_by_step(agg, "decile", ["target", "non_target"], DS).select("dataset", "decile", "cum_target", "cum_non_target")


AUC_SQL = """SELECT {g}, (sum(rk) FILTER (label = 1) - CAST(count(*) FILTER (label = 1) AS DOUBLE) * (count(*) FILTER (label = 1) + 1) / 2)
  / (CAST(count(*) FILTER (label = 1) AS DOUBLE) * count(*) FILTER (label = 0)) AS auc FROM (SELECT *, rank() OVER (PARTITION BY {g} ORDER BY score)
  + (count(*) OVER (PARTITION BY {g}, score) - 1) / CAST(2 AS DOUBLE) AS rk FROM {t}) GROUP BY {g}"""


@query("e1_auc", sql(f"SELECT dataset, {r('auc')} AS auc FROM a", "scored", a=AUC_SQL.format(g="dataset", t="scored")))
def e1(spark, sf):
    return rounded(BM.auc(X.scored(spark, sf), by=DS))


@query("e2_accuracy", sql(f"SELECT dataset, {r('avg(CASE WHEN label = prediction THEN 1 ELSE 0 END)')} AS accuracy FROM scored GROUP BY dataset", "scored"))
def e2(spark, sf):
    return rounded(BM.accuracy(X.scored(spark, sf), by=DS))


@query("e3_ks_table", sql(f"""SELECT dataset, decile, count, target, non_target, cum_target, cum_non_target, {r('100 * target / CAST(count AS DOUBLE)')} AS pct_target,
  {r('100 * cum_target / CAST(tt AS DOUBLE)')} AS dist_target, {r('100 * cum_non_target / CAST(nt AS DOUBLE)')} AS dist_non_target,
  {r('abs(100 * cum_target / CAST(tt AS DOUBLE) - 100 * cum_non_target / CAST(nt AS DOUBLE))')} AS spread FROM cum""", "scored", dec=DECILE, cum=CUM))
def e3(spark, sf):
    return rounded(BM.decile_table(X.scored(spark, sf), "label", "score", "key", DS))


KS_SQL = "SELECT dataset, round(max(abs(100 * cum_target / CAST(tt AS DOUBLE) - 100 * cum_non_target / CAST(nt AS DOUBLE))), 2) AS ks FROM cum GROUP BY dataset"


@query("e3_ks_value", sql("SELECT * FROM k", "scored", dec=DECILE, cum=CUM, k=KS_SQL))
def e3_ks(spark, sf):
    return BM.ks(BM.decile_table(X.scored(spark, sf), "label", "score", "key", DS), DS)


@query("e4_roc_points", sql(f"""SELECT dataset, score AS threshold, {r('sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE)')} AS fpr,
  {r('sum(p) OVER w / CAST(sum(p) OVER (PARTITION BY dataset) AS DOUBLE)')} AS tpr FROM (SELECT dataset, score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY dataset, score)
  WINDOW w AS (PARTITION BY dataset ORDER BY score DESC)""", "scored"))
def e4(spark, sf):
    return rounded(BM.roc_points(X.scored(spark, sf), by=DS))


@query("e4_roc_thinned", sql(f"""SELECT dataset, arg_max(threshold, (fpr, tpr)) AS threshold, {r('max(fpr)')} AS fpr, {r('max(tpr)')} AS tpr FROM (
  SELECT dataset, score AS threshold, sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY dataset) AS DOUBLE) AS fpr, sum(p) OVER w / CAST(sum(p) OVER (PARTITION BY dataset) AS DOUBLE) AS tpr
  FROM (SELECT dataset, score, sum(label) AS p, sum(1 - label) AS n FROM scored GROUP BY dataset, score) WINDOW w AS (PARTITION BY dataset ORDER BY score DESC))
  GROUP BY dataset, floor((fpr + tpr) / 2 * 20)""", "scored"))
def e4_thin(spark, sf):
    return rounded(BM.roc_points(X.scored(spark, sf), by=DS, points=20))


def class_fixture(spark, sf):
    """Order status as three-class label; the prediction follows price and priority."""
    return X.labelled(spark, sf).selectExpr("key", "dataset", "status AS label", CLASS_GUESS + " AS prediction")


CLASS_GUESS = "CASE WHEN base_price > 350000 THEN 'F' WHEN priority IN ('1-URGENT', '2-HIGH') THEN status WHEN base_price > 150000 THEN 'O' ELSE 'P' END"
GUESSED = f"SELECT key, dataset, status AS label, {CLASS_GUESS} AS prediction FROM labelled"
PER_CLASS = """SELECT a.dataset, a.class, support, tp, coalesce(predicted, 0) AS predicted, tp / CAST(support AS DOUBLE) AS rec,
  coalesce(tp / CAST(nullif(predicted, 0) AS DOUBLE), 0) AS prec FROM
  (SELECT dataset, label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS tp FROM guessed GROUP BY ALL) a LEFT JOIN
  (SELECT dataset, prediction AS class, count(*) AS predicted FROM guessed GROUP BY ALL) b ON a.dataset = b.dataset AND a.class = b.class"""
F1 = "(CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END)"
WEIGHTED = f"SELECT dataset, sum(tp) / CAST(sum(support) AS DOUBLE) AS accuracy, sum(support * {F1}) / sum(support) AS f1, sum(support * prec) / sum(support) AS precision, sum(support * rec) / sum(support) AS recall FROM pc GROUP BY dataset"


@query("e5_confusion", sql("SELECT dataset, label, prediction, count(*) AS count FROM guessed GROUP BY ALL", "labelled", guessed=GUESSED))
def e5(spark, sf):
    return BM.confusion(class_fixture(spark, sf), by=DS)


@query("e5_weighted_scores", sql(f"SELECT dataset, {r('accuracy')} AS accuracy, {r('f1')} AS f1, {r('precision')} AS precision, {r('recall')} AS recall FROM w", "labelled",
                                 guessed=GUESSED, pc=PER_CLASS, w=WEIGHTED))
def e5_weighted(spark, sf):
    return rounded(BM.weighted_scores(BM.confusion(class_fixture(spark, sf), by=DS), DS))


@query("e6_multiclass_metrics", sql(f"SELECT dataset, metric, {r('value')} AS value FROM (UNPIVOT w ON accuracy, f1, precision, recall INTO NAME metric VALUE value)", "labelled",
                                    guessed=GUESSED, pc=PER_CLASS, w=WEIGHTED))
def e6(spark, sf):
    return rounded(BM.validate_multiclass(class_fixture(spark, sf)))


@query("e7_binary_validation", sql(f"""SELECT dataset, 'roc' AS metric, {r('auc')} AS value FROM a UNION ALL SELECT dataset, 'ks', {r('ks')} FROM k UNION ALL
  SELECT dataset, 'accuracy', {r('avg(CASE WHEN label = prediction THEN 1 ELSE 0 END)')} FROM scored GROUP BY dataset""", "scored",
                                   a=AUC_SQL.format(g="dataset", t="scored"), dec=DECILE, cum=CUM, k=KS_SQL))
def e7(spark, sf):
    return rounded(BM.validate_binary(X.scored(spark, sf), "key"))


BASIC = ("sqrt(avg((target - prediction) ** 2)) AS rmse, avg(abs(target - prediction)) AS mae, 1 - avg((target - prediction) ** 2) / var_pop(target) AS r2, "
         "avg((target - prediction) ** 2) AS mse")


@query("e8_regression_metrics", sql(f"SELECT dataset, {r('rmse')} AS rmse, {r('mae')} AS mae, {r('r2')} AS r2, {r('mse', 2)} AS mse FROM (SELECT dataset, {BASIC} FROM priced GROUP BY dataset)", "priced"))
def e8(spark, sf):
    return rounded(RM.basic_metrics(X.priced(spark, sf), "target", by=DS), mse=2)


PCT = "avg(abs((target - prediction) / CASE WHEN target = 0 THEN 1e-8 ELSE target END)) * 100 AS mape, 1 - var_pop(target - prediction) / var_pop(target) AS explained_variance"


@query("e9_percentage_metrics", sql(f"SELECT dataset, {r('mape')} AS mape, {r('explained_variance')} AS explained_variance FROM (SELECT dataset, {PCT} FROM priced GROUP BY dataset)", "priced"))
def e9(spark, sf):
    return rounded(RM.percentage_metrics(X.priced(spark, sf), "target", by=DS))


E = "(target - prediction)"
EXTENDED = f"""SELECT p.dataset, max(abs{E}) AS max_error, avg((ln(1 + target) - ln(1 + prediction)) ** 2) AS msle, avg{E} AS residual_mean, stddev_samp{E} AS residual_std,
  avg(({E} - m) ** 3) / avg(({E} - m) ** 2) ** 15e-1 AS residual_skewness, kurtosis_pop{E} AS residual_kurtosis, avg(prediction) AS prediction_mean,
  stddev_samp(prediction) AS prediction_std, avg(target) AS actual_mean, stddev_samp(target) AS actual_std, count(*) AS n_samples,
  quantile_cont(abs{E}, 0.5) AS median_absolute_error FROM priced p JOIN (SELECT dataset, avg{E} AS m FROM priced GROUP BY dataset) c ON p.dataset = c.dataset GROUP BY p.dataset"""
_EXT_COLS = ["max_error", "msle", "residual_mean", "residual_std", "residual_skewness", "residual_kurtosis", "prediction_mean", "prediction_std", "actual_mean", "actual_std", "median_absolute_error"]


@query("e10_extended_metrics", sql("SELECT dataset, n_samples, " + ", ".join(f"{r(c)} AS {c}" for c in _EXT_COLS) + " FROM x", "priced", x=EXTENDED))
def e10(spark, sf):
    return rounded(RM.extended_metrics(X.priced(spark, sf), "target", by=DS, exact=True))


_ABS = f"abs{E}"
_REL = f"(abs{E} / CASE WHEN abs(target) > 1e-8 THEN abs(target) ELSE 1e-8 END * 100)"


def _summary(name: str, e: str) -> str:
    q = ", ".join(f"{r(f'quantile_cont({e}, {p})')} AS {n}" for p, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")))
    return f"SELECT dataset, '{name}' AS error, {r(f'avg({e})')} AS mean, {r(f'max({e})')} AS max, {q} FROM priced GROUP BY dataset"


@query("e11_error_summary", sql(_summary("absolute", _ABS) + " UNION ALL " + _summary("relative", _REL), "priced"))
def e11(spark, sf):
    return rounded(RM.error_summary(X.priced(spark, sf), "target", by=DS, exact=True))


@query("e12_residual_histogram", sql(f"""SELECT dataset, bin, {r('lo + bin * w')} AS bin_start, {r('lo + (bin + 1) * w')} AS bin_end, count(*) AS count, {r('m')} AS residual_mean, {r('s')} AS residual_std
  FROM (SELECT p.dataset, lo, w, m, s, CAST(least(floor(({E} - lo) / w), 29) AS INT) AS bin FROM priced p JOIN (SELECT dataset, min{E} AS lo, (max{E} - min{E}) / 30 AS w,
  avg{E} AS m, stddev_samp{E} AS s FROM priced GROUP BY dataset) c ON p.dataset = c.dataset) GROUP BY dataset, bin, lo, w, m, s""", "priced"))
def e12(spark, sf):
    return rounded(RM.residual_histogram(X.priced(spark, sf), "target", by=DS))


@query("e13_residual_trend", sql(f"SELECT dataset, {r(f'regr_slope({E}, prediction)')} AS slope, {r(f'regr_intercept({E}, prediction)')} AS intercept, count(*) AS n FROM priced GROUP BY dataset", "priced"))
def e13(spark, sf):
    return rounded(RM.residual_trend(X.priced(spark, sf), "target", by=DS))


_PROBS = ", ".join(str(i / 100) for i in range(1, 100))


def _normal_quantiles() -> str:
    from statistics import NormalDist
    return ", ".join(f"CAST('{NormalDist().inv_cdf(i / 100)!r}' AS DOUBLE)" for i in range(1, 100))


@query("e14_qq_fit", sql(f"""SELECT dataset, {r('corr(t, s) ** 2')} AS qq_r2 FROM (SELECT dataset, unnest(quantile_cont({E}, [{_PROBS}])) AS s, unnest([{_normal_quantiles()}]) AS t
  FROM priced GROUP BY dataset) GROUP BY dataset""", "priced"))
def e14(spark, sf):
    return rounded(RM.qq_fit(RM.qq_table(X.priced(spark, sf), "target", by=DS, exact=True), DS))


# about the asked number of points per dataset
@query("e15_sample_points", sql(f"""SELECT dataset, okey, line, part, supp, {r('target')} AS actual, {r('prediction')} AS predicted FROM (SELECT *, count(*) OVER (PARTITION BY dataset) AS n,
  {u_sql('okey', 'line', 'part', 'supp', seed=42)} AS u FROM priced) WHERE u < CAST(1000 AS DOUBLE) / n""", "priced"))
def e15(spark, sf):
    return rounded(RM.sample_points(X.priced(spark, sf), "target", ["okey", "line", "part", "supp"], by=DS, n=1000))


_LONG = " UNION ALL ".join(f"SELECT dataset, '{m}' AS metric, {m} AS value FROM allm" for m in RM.METRICS)
_ALLM = f"SELECT b.*, c.* EXCLUDE (dataset), x.* EXCLUDE (dataset) FROM (SELECT dataset, {BASIC} FROM priced GROUP BY dataset) b JOIN (SELECT dataset, {PCT} FROM priced GROUP BY dataset) c ON b.dataset = c.dataset JOIN x ON b.dataset = x.dataset"


@query("e16_regression_validation", sql(f"SELECT dataset, metric, {r('value', 2)} AS value FROM ({_LONG})", "priced", x=EXTENDED, allm=_ALLM))
def e16(spark, sf):
    return rounded(RM.validate_regression(X.priced(spark, sf), "target", exact=True), 2)


@query("g3_residuals", sql(f"SELECT okey, line, target, prediction, {E} AS residual, abs{E} AS absolute_error FROM priced", "priced"))
def g3(spark, sf):
    return with_residuals(X.priced(spark, sf).select("okey", "line", "target", "prediction"), "target")
