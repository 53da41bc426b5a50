"""MS1-MS9, T5, FS4, FS5, FS9: model choice and statistics-based selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import binary_metrics as BM, cluster_metrics as CM, regression_metrics as RM, select as FS, selection as S
from featurelens.operators.shared import pin_small
from workload import fixtures as X
from workload.cluster_queries import DATASET, geometry
from workload.fixtures import sql
from workload.metric_queries import AUC_SQL
from workload.registry import query, r, rounded

# metric rows of four scoring formulas over all labelled orders
BY = ["model", "dataset"]
MD_ORDER = "PARTITION BY model, dataset ORDER BY score DESC, u, key"
CLASS_ROWS = {
    "a": AUC_SQL.format(g="model, dataset", t="scored_models"),
    "dec": f"SELECT model, dataset, decile, sum(label) AS target, sum(1 - label) AS non_target FROM (SELECT *, ntile(10) OVER (PARTITION BY model, dataset ORDER BY score DESC, v, key) AS decile "
           "FROM (SELECT *, {U} AS v FROM scored_models)) GROUP BY ALL",
    "cum": "SELECT *, sum(target) OVER w AS ct, sum(non_target) OVER w AS cn, sum(target) OVER (PARTITION BY model, dataset) AS tt, sum(non_target) OVER (PARTITION BY model, dataset) AS nt "
           "FROM dec WINDOW w AS (PARTITION BY model, dataset ORDER BY decile ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "m": "SELECT model, dataset, 'roc' AS metric, auc AS value FROM a UNION ALL SELECT model, dataset, 'ks', round(max(abs(100 * ct / CAST(tt AS DOUBLE) - 100 * cn / CAST(nt AS DOUBLE))), 2) FROM cum GROUP BY ALL "
         "UNION ALL SELECT model, dataset, 'accuracy', avg(CASE WHEN label = prediction THEN 1 ELSE 0 END) FROM scored_models GROUP BY ALL",
}
CLASS_ROWS["dec"] = CLASS_ROWS["dec"].replace("{U}", X.u_sql("key"))


def class_rows(spark, sf):
    return pin_small(BM.validate_binary(X.scored_models(spark, sf), "key", by=BY))[0]


# metric rows of four price formulas over all line items
FACTORS = [("flat", 1480.0), ("low", 1400.0), ("mid", 1500.0), ("top", 1510.0)]
REG_ROWS = {
    "p": "SELECT m.model, dataset, target, quantity * CAST(m.f AS DOUBLE) AS prediction FROM priced, (VALUES " + ", ".join(str(f) for f in FACTORS) + ") m(model, f)",
    "w": "SELECT model, dataset, sqrt(avg((target - prediction) ** 2)) AS rmse, avg(abs(target - prediction)) AS mae, 1 - avg((target - prediction) ** 2) / var_pop(target) AS r2 FROM p GROUP BY ALL",
    "m": "SELECT model, dataset, 'rmse' AS metric, rmse AS value FROM w UNION ALL SELECT model, dataset, 'mae', mae FROM w UNION ALL SELECT model, dataset, 'r2', r2 FROM w",
}


def regression_rows(spark, sf):
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.lit(f).alias("f")) for n, f in FACTORS])
    df = X.priced(spark, sf).select("*", F.inline(models)).withColumn("prediction", F.col("quantity") * F.col("f"))
    wide = RM.basic_metrics(df, "target", by=BY)
    return pin_small(BM.to_metric_rows(wide, BY, ["rmse", "mae", "r2"]))[0]


def champion_sql(metric: str, limit: float, direction: str) -> str:
    return f"""SELECT model, {r('score')} AS score, unstable_datasets, row_number() OVER (ORDER BY unstable_datasets, score {direction}, model) AS rank, '{metric}' AS metric,
      CASE row_number() OVER (ORDER BY unstable_datasets, score {direction}, model) WHEN 1 THEN 'Champion' WHEN 2 THEN 'Challenger' ELSE '' END AS role
      FROM (SELECT x.model, x.value AS score, (SELECT count(*) FROM m y WHERE y.model = x.model AND y.metric = '{metric}' AND abs(y.value - x.value) > {limit}) AS unstable_datasets
      FROM m x WHERE x.metric = '{metric}' AND x.dataset = 'train')"""


@query("ms1_champion_classification", sql(champion_sql("ks", 3, "DESC"), "scored_models", **CLASS_ROWS))
def ms1(spark, sf):
    return rounded(S.champion_classification(class_rows(spark, sf), "ks", "train"))


@query("ms2_champion_regression", sql(champion_sql("r2", 0.02, "DESC"), "priced", **REG_ROWS))
def ms2(spark, sf):
    return rounded(S.champion_regression(regression_rows(spark, sf), "r2", "train"))


# silhouettes of six labelings on three datasets
CLU = {"base": f"SELECT k || '/' || {DATASET} AS g, vec_id, x, prediction FROM k_tables"} | geometry("g", "base")
CLU["scores"] = "SELECT split_part(g, '/', 1) AS model, split_part(g, '/', 2) AS source, avg(sil) AS value FROM sil GROUP BY g"


@query("ms3_best_clustering", sql(f"""SELECT model AS best_model, {r('value')} AS best_score FROM scores WHERE source = 'train' ORDER BY value DESC, model DESC LIMIT 1""", "k_tables", **CLU))
def ms3(spark, sf):
    df = X.k_tables(spark, sf).withColumn("dataset", F.expr(DATASET))
    q = CM.evaluate_clusters(df, by=["k", "dataset"])
    return rounded(S.best_clustering(q.select(F.col("k").cast("string").alias("model"), F.col("dataset").alias("source"), F.col("silhouette").alias("value"))))


@query("ms4_stability", sql(f"""SELECT model, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('max(value) - min(value)')} AS range,
  count(*) AS datasets, {r('stddev_pop(value) / avg(value)')} AS cv FROM m WHERE metric = 'ks' GROUP BY model""", "scored_models", **CLASS_ROWS))
def ms4(spark, sf):
    return rounded(S.stability(class_rows(spark, sf), "ks"))


GAP = "SELECT model, max(value) FILTER (dataset = 'train') AS t, max(value) FILTER (dataset = 'oot1') AS v FROM m WHERE metric = 'roc' GROUP BY model"


@query("ms5_tuned_or_default", sql(f"""SELECT {r('ds')} AS default_score, {r('ts')} AS tuned_score, {r('dg')} AS default_overfitting, {r('tg')} AS tuned_overfitting, {r('(ts - ds) / abs(ds) * 100')} AS improvement_pct,
  CASE WHEN ts <= ds OR (ts - ds) / abs(ds) * 100 < 1 OR tg > dg + 0.05 THEN 'default' ELSE 'tuned' END AS decision,
  CASE WHEN ts <= ds THEN 'not better' WHEN (ts - ds) / abs(ds) * 100 < 1 THEN 'improvement below threshold' WHEN tg > dg + 0.05 THEN 'more overfitting' ELSE 'improved' END AS reason
  FROM (SELECT max(v) FILTER (model = 'alpha') AS ds, max(v) FILTER (model = 'gamma') AS ts, max((t - v) / t) FILTER (model = 'alpha') AS dg, max((t - v) / t) FILTER (model = 'gamma') AS tg FROM gap)""",
                                   "scored_models", **CLASS_ROWS, gap=GAP))
def ms5(spark, sf):
    rows = class_rows(spark, sf).where(F.col("dataset") != "oot2").withColumn("dataset", F.when(F.col("dataset") == "oot1", "valid").otherwise(F.col("dataset")))
    return rounded(S.tuned_or_default(rows, "roc", "alpha", "gamma"))


@query("ms6_overfit_gap", sql(f"SELECT model, {r('t')} AS train_value, {r('v')} AS valid_value, {r('(t - v) / t')} AS overfit_gap FROM gap", "scored_models", **CLASS_ROWS, gap=GAP))
def ms6(spark, sf):
    return rounded(S.overfit_gap(class_rows(spark, sf), "roc", "train", "oot1"))


@query("ms8_detailed_comparison", sql(f"SELECT model, metric, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max FROM m GROUP BY ALL",
                                      "scored_models", **CLASS_ROWS))
def ms8(spark, sf):
    return rounded(S.detailed_comparison(class_rows(spark, sf)))


@query("ms9_selection_summary", sql(f"SELECT m.model, dataset, m.metric, {r('value')} AS value, rank, role, unstable_datasets FROM m JOIN c ON m.model = c.model", "scored_models", **CLASS_ROWS,
                                    c=champion_sql("ks", 3, "DESC")))
def ms9(spark, sf):
    rows = class_rows(spark, sf)
    return rounded(S.selection_summary(rows, S.champion_classification(rows, "ks", "train")))


@query("t5_model_ranking", sql(f"SELECT model, {r('value')} AS value, row_number() OVER (ORDER BY value DESC, model) AS rank FROM m WHERE metric = 'ks' AND dataset = 'oot1'", "scored_models", **CLASS_ROWS))
def t5(spark, sf):
    return rounded(S.ranking(class_rows(spark, sf), "ks", "oot1"))


BASES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# 240 columns: each measure under sixty arithmetic variants
WIDE = [(f"{b}_{i}", f"{b} * {i}e0 + (l_linenumber % {i + 1})") for b in BASES for i in range(1, 61)]
WIDE_SQL = "SELECT l_extendedprice * (1 - l_discount) AS y, " + ", ".join(f"{e} AS {n}" for n, e in WIDE) + " FROM lineitem"


def wide(spark, sf):
    return X.table(spark, sf, "lineitem").selectExpr("l_extendedprice * (1 - l_discount) AS y", *[f"{e} AS {n}" for n, e in WIDE])


STAT = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, var_samp({n}) AS variance, corr({n}, y) AS correlation FROM wide" for n, _ in WIDE) + ")"


@query("fs4_statistical_selection", sql(f"""SELECT * FROM (SELECT feature, {r('correlation', 5)} AS correlation, row_number() OVER (ORDER BY abs(correlation) DESC, feature) <= 60 AS top
  FROM st WHERE variance > 1e-6) WHERE top AND feature LIKE 'l_extendedprice%'""", wide=WIDE_SQL, st=STAT))
def fs4(spark, sf):
    names = [n for n, _ in WIDE]
    return rounded(FS.statistical_selection(wide(spark, sf), names, "y", 60).select("feature", "correlation", F.lit(True).alias("top")), 5).where("feature LIKE 'l_extendedprice%'")


@query("fs5_variance_selection", sql(f"""SELECT feature, {r('variance', 0)} AS variance, {r('importance')} AS importance, rank FROM (SELECT feature, variance, variance / sum(variance) OVER () AS importance,
  row_number() OVER (ORDER BY variance DESC, feature) AS rank FROM st) WHERE rank <= 10""", wide=WIDE_SQL, st=STAT))
def fs5(spark, sf):
    return rounded(FS.variance_selection(wide(spark, sf), [n for n, _ in WIDE], 10), variance=0)


# the dropped columns follow from the data: constant text dates, gaps and categories
@query("fs9_audit_trail", sql("""SELECT 'cardinality' AS drop_step, 'customer' AS variable WHERE (SELECT count(DISTINCT customer) FROM gaps) > 50 UNION ALL SELECT 'dates', unnest(['order_date_text', 'ts']) UNION ALL
  SELECT 'missing', 'mostly_null' WHERE (SELECT count(*) FILTER (mostly_null IS NULL) / CAST(count(*) AS DOUBLE) FROM gaps) > 0.75 UNION ALL
  SELECT 'cardinality', 'txt' WHERE (SELECT count(DISTINCT txt) FROM gaps) > 50 UNION ALL SELECT '', unnest(['num', 'cat', 'const', 'status_time', 'flag'])""", "gaps"))
def fs9(spark, sf):
    from featurelens.operators.transform import fit_preprocessor
    g = X.gaps(spark, sf).withColumn("target", F.col("key") % 2)
    pre = fit_preprocessor(g, "target", exclude=["key"], exact=True)
    types = {f.name: f.dataType.simpleString() for f in g.schema if f.name not in ("target", "key")}
    trail = FS.audit_trail(spark, types, [d for d in pre.dropped if d[0] != "key"], pre.raw_columns)
    return trail.select(F.coalesce("drop_step", F.lit("")).alias("drop_step"), "variable")
