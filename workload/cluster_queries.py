"""E17-E30, C1-C6, MS10: cluster quality and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import cluster_metrics as CM, clusters as CL, selection as S
from workload import fixtures as X
from workload.fixtures import sql
from workload.registry import query, r, rounded

# centres and distances per group and cluster as SQL
DIM = "SELECT {g}, prediction AS cluster, i, avg(x[i]) AS c, count(*) AS n FROM {t}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL"
CEN = "SELECT {g}, cluster, list(c ORDER BY i) AS centre, max(n) AS n FROM dims GROUP BY ALL"
DIST = "SELECT t.{g}, vec_id, t.prediction AS cluster, x, list_distance(x, centre) AS d FROM {t} t JOIN cen c ON t.{g} = c.{g} AND t.prediction = c.cluster"
WITHIN = "SELECT {g}, cluster, sum(d * d) AS w, avg(d) AS s, max(d) AS mx FROM dist GROUP BY ALL"
ALLD = ("SELECT t.{g}, t.vec_id, t.prediction AS own, c.cluster, c.n, list_distance(t.x, c.centre) ** 2 + w.w / c.n AS m FROM {t} t JOIN cen c ON t.{g} = c.{g} "
        "JOIN within w ON c.{g} = w.{g} AND c.cluster = w.cluster")
SIL = ("SELECT {g}, vec_id, own AS cluster, CASE WHEN max(n) FILTER (cluster = own) = 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS sil FROM (SELECT *, "
       "max(CASE WHEN cluster = own THEN m * n / (n - 1) END) OVER (PARTITION BY {g}, vec_id) AS a, min(CASE WHEN cluster <> own THEN m END) OVER (PARTITION BY {g}, vec_id) AS b FROM alld) GROUP BY {g}, vec_id, own, a, b")
PAIRS = "SELECT a.{g}, a.cluster AS i, b.cluster AS j, list_distance(a.centre, b.centre) AS d FROM cen a JOIN cen b ON a.{g} = b.{g} AND a.cluster <> b.cluster"
DB = ("SELECT {g}, avg(worst) AS davies_bouldin FROM (SELECT p.{g}, p.i, max((a.s + b.s) / p.d) AS worst FROM pairs p JOIN within a ON a.{g} = p.{g} AND a.cluster = p.i "
      "JOIN within b ON b.{g} = p.{g} AND b.cluster = p.j GROUP BY ALL) GROUP BY {g}")
GRAND = "SELECT {g}, i, avg(x[i]) AS c FROM {t}, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL"
CH = ("SELECT d.{g}, (sum(d.n * (d.c - g.c) ** 2) / (max(kk) - 1)) / (max(ww) / (max(nn) - max(kk))) AS calinski_harabasz FROM dims d JOIN grand g ON d.{g} = g.{g} AND d.i = g.i "
      "JOIN (SELECT {g}, sum(w) AS ww, count(*) AS kk FROM within GROUP BY {g}) w ON w.{g} = d.{g} JOIN (SELECT {g}, count(*) AS nn FROM {t} GROUP BY {g}) n ON n.{g} = d.{g} GROUP BY d.{g}")


def geometry(g: str, t: str, *names: str) -> dict[str, str]:
    every = {"dims": DIM, "cen": CEN, "dist": DIST, "within": WITHIN, "alld": ALLD, "sil": SIL, "pairs": PAIRS, "db": DB, "grand": GRAND, "ch": CH}
    return {n: every[n].replace("{g}", g).replace("{t}", t) for n in every}


BASE = {"base": "SELECT 1 AS g, * FROM clustered"} | geometry("g", "base")


def csql(body: str) -> str:
    return sql(body, "clustered", **BASE)


@query("e17_silhouette", csql(f"SELECT {r('avg(sil)')} AS silhouette FROM sil"))
def e17(spark, sf):
    return rounded(CM.silhouette(X.clustered(spark, sf)))


@query("e18_inertia", csql(f"SELECT {r('sum(w)')} AS inertia FROM within"))
def e18(spark, sf):
    return rounded(CM.inertia(X.clustered(spark, sf)))


@query("e19_calinski_harabasz", csql(f"SELECT {r('calinski_harabasz')} AS calinski_harabasz FROM ch"))
def e19(spark, sf):
    return rounded(CM.calinski_harabasz(X.clustered(spark, sf)))


@query("e20_davies_bouldin", csql(f"SELECT {r('davies_bouldin')} AS davies_bouldin FROM db"))
def e20(spark, sf):
    return rounded(CM.davies_bouldin(X.clustered(spark, sf)))


@query("e21_cluster_sizes", sql(f"""SELECT count(*) AS num_clusters, min(n) AS min_cluster_size, max(n) AS max_cluster_size, {r('avg(n)')} AS mean_cluster_size,
  {r('stddev_pop(n)')} AS cluster_size_std, sum(n) AS sample_count, {r('stddev_pop(n) / avg(n)')} AS cluster_balance FROM (SELECT count(*) AS n FROM clustered GROUP BY prediction)""", "clustered"))
def e21(spark, sf):
    return rounded(CM.cluster_sizes(X.clustered(spark, sf)))


@query("e22_centre_distances", csql(f"SELECT {r('min(d)')} AS min_inter_cluster_distance, {r('max(d)')} AS max_inter_cluster_distance, {r('avg(d)')} AS mean_inter_cluster_distance FROM pairs"))
def e22(spark, sf):
    return rounded(CM.centre_distances(X.clustered(spark, sf)))


@query("e23_cluster_density", csql(f"SELECT cluster, count(*) AS size, {r('avg(d)')} AS mean_distance, {r('max(d)')} AS max_distance FROM dist GROUP BY cluster"))
def e23(spark, sf):
    return rounded(CM.cluster_density(X.clustered(spark, sf)))


@query("e23_cluster_centres", csql(f"SELECT cluster, CAST(i - 1 AS INT) AS dimension, {r('c')} AS value FROM dims"))
def e23_centres(spark, sf):
    return rounded(CM.centre_rows(CM.centres(X.clustered(spark, sf))))


@query("e24_silhouette_rows", csql(f"SELECT vec_id, cluster, {r('sil')} AS silhouette FROM sil"))
def e24(spark, sf):
    return rounded(CM.point_geometry(X.clustered(spark, sf), keep=["vec_id"]).select("vec_id", "cluster", "silhouette"))


@query("e24_silhouette_by_cluster", csql(f"""SELECT cluster, count(*) AS size, {r('avg(sil)')} AS mean_silhouette, {r('min(sil)')} AS min_silhouette, {r('max(sil)')} AS max_silhouette,
  {r('avg(CASE WHEN sil < 0 THEN 1 ELSE 0 END)')} AS negative_share FROM sil GROUP BY cluster"""))
def e24_cluster(spark, sf):
    return rounded(CM.silhouette_by_cluster(X.clustered(spark, sf)))


# the elbow table of six labelings of the embeddings (label modulo k)
KSQL = geometry("k", "k_tables") | {"elbow": (
    "SELECT w.k, sum(w.w) AS inertia, (SELECT avg(sil) FROM sil s WHERE s.k = w.k) AS silhouette, (SELECT calinski_harabasz FROM ch WHERE ch.k = w.k) AS calinski_harabasz, "
    "(SELECT davies_bouldin FROM db WHERE db.k = w.k) AS davies_bouldin FROM within w GROUP BY w.k")}


def elbow_frame(spark, sf):
    return CM.evaluate_clusters(X.k_tables(spark, sf), by=["k"])


@query("e25_quality_by_k", sql(f"SELECT k, {r('inertia')} AS inertia, {r('silhouette')} AS silhouette, {r('calinski_harabasz')} AS calinski_harabasz, {r('davies_bouldin')} AS davies_bouldin FROM elbow",
                               "k_tables", **KSQL))
def e25_quality(spark, sf):
    return rounded(elbow_frame(spark, sf).select("k", "inertia", "silhouette", "calinski_harabasz", "davies_bouldin"))


BEND = "SELECT k, lead(inertia) OVER (ORDER BY k) - 2 * inertia + lag(inertia) OVER (ORDER BY k) AS bend FROM elbow"


@query("e26_elbow", sql("SELECT k AS elbow_k FROM bend WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1", "k_tables", **KSQL, bend=BEND))
def e26(spark, sf):
    return CM.find_elbow(elbow_frame(spark, sf))


@query("e27_k_recommendation", sql("""(SELECT 'elbow' AS criterion, k FROM bend WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1) UNION ALL
  (SELECT 'silhouette', k FROM elbow WHERE silhouette > 0 ORDER BY silhouette DESC, k LIMIT 1) UNION ALL
  (SELECT 'calinski_harabasz', k FROM elbow WHERE calinski_harabasz > 0 ORDER BY calinski_harabasz DESC, k LIMIT 1) UNION ALL
  (SELECT 'davies_bouldin', k FROM elbow ORDER BY davies_bouldin, k LIMIT 1)""", "k_tables", **KSQL, bend=BEND))
def e27(spark, sf):
    return CM.recommend_k(elbow_frame(spark, sf))


@query("ms10_choose_k", sql("""SELECT (SELECT k FROM elbow ORDER BY silhouette DESC, k LIMIT 1) AS silhouette_k, (SELECT count(*) FROM elbow) AS tried,
  (SELECT k FROM bend WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1) AS elbow_k, (SELECT k FROM bend WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1) AS best_k""",
                            "k_tables", **KSQL, bend=BEND))
def ms10(spark, sf):
    return S.choose_k(elbow_frame(spark, sf))


# label 0 plays the noise
NOISE = {"base": "SELECT 1 AS g, vec_id, x, prediction FROM clustered WHERE prediction <> 0"} | geometry("g", "base")


@query("e28_noise_summary", sql(f"""SELECT (SELECT count(*) FROM clustered) AS rows, {r('100 * (SELECT count(*) FROM clustered WHERE prediction = 0) / CAST((SELECT count(*) FROM clustered) AS DOUBLE)')} AS noise_percentage,
  (SELECT count(DISTINCT prediction) FROM base) AS n_clusters, {r('(SELECT avg(sil) FROM sil)')} AS silhouette""", "clustered", **NOISE))
def e28(spark, sf):
    df = X.clustered(spark, sf).withColumn("prediction", F.when(F.col("prediction") == 0, -1).otherwise(F.col("prediction")))
    return rounded(CM.noise_summary(df))


# components are centred-variance directions: their variances are ordered and match the explained shares
@query("e29_pca_projection")
def e29(spark, sf):
    out, shares = CM.project_2d(X.clustered(spark, sf), keep=["vec_id"])
    v = out.agg(F.variance("pc1").alias("v1"), F.variance("pc2").alias("v2"), F.count(F.lit(1)).alias("n"), F.abs(F.corr("pc1", "pc2")).alias("c"))
    return v.select("n", (F.col("v1") >= F.col("v2")).alias("ordered"), (F.abs(F.col("v1") / F.col("v2") - shares[0] / shares[1]) < 1e-6).alias("shares_match"), (F.col("c") < 1e-6).alias("uncorrelated"))


DATASET = "CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 < 8 THEN 'valid' ELSE 'test' END"
ACROSS = {"base": f"SELECT {DATASET} AS dataset, * FROM clustered"} | geometry("dataset", "base")


@query("e30_dataset_comparison", sql(f"""SELECT (SELECT dataset FROM m ORDER BY s DESC, dataset DESC LIMIT 1) AS best_silhouette_dataset, {r('stddev_pop(s)')} AS silhouette_std,
  min(k) = max(k) AS consistent_cluster_count, sum(n) AS total_samples FROM m""", "clustered", **ACROSS,
    m="SELECT dataset, avg(sil) AS s, count(DISTINCT cluster) AS k, count(*) AS n FROM sil GROUP BY dataset"))
def e30(spark, sf):
    df = X.clustered(spark, sf).withColumn("dataset", F.expr(DATASET))
    return rounded(CM.compare_datasets(CM.evaluate_clusters(df, by=["dataset"])))


NUM = ["price", "balance"]
CAT = ["priority", "segment_gaps"]


@query("c1_cluster_sizes", sql(f"SELECT cluster, count(*) AS size, {r('100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS percentage FROM cluster_rows GROUP BY cluster", "cluster_rows"))
def c1(spark, sf):
    return rounded(CL.sizes(X.cluster_rows(spark, sf)))


C2 = " UNION ALL ".join(f"""SELECT cluster, '{c}' AS feature, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS stddev, quantile_cont({c}, 0.5) AS median, min({c}) AS min, max({c}) AS max,
  (SELECT avg({c}) FROM cluster_rows) AS overall_mean, (SELECT stddev_samp({c}) FROM cluster_rows) AS overall_std FROM cluster_rows GROUP BY cluster""" for c in NUM)


@query("c2_numeric_profiles", sql("SELECT cluster, feature, count, " + ", ".join(f"{r(c)} AS {c}" for c in ["mean", "stddev", "median", "min", "max", "overall_mean", "overall_std"])
                                  + f", {r('(mean - overall_mean) / overall_mean * 100')} AS pct_diff FROM c2", "cluster_rows", c2=C2))
def c2(spark, sf):
    return rounded(CL.numeric_profiles(X.cluster_rows(spark, sf), NUM, exact=True))


CLONG = " UNION ALL ".join(f"SELECT cluster, '{c}' AS feature, {c} AS value FROM cluster_rows" for c in CAT)
CTOP = "SELECT feature, value FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS k FROM clong WHERE value IS NOT NULL GROUP BY feature, value) WHERE k <= 3"


@query("c3_categorical_profiles", sql(f"""SELECT cluster, feature, category, count, {r('100 * count / CAST(sum(count) OVER (PARTITION BY cluster, feature) AS DOUBLE)')} AS percentage
  FROM (SELECT cluster, feature, category, count(*) AS count FROM (SELECT l.cluster, l.feature, CASE WHEN t.value IS NOT NULL THEN l.value ELSE 'Other' END AS category FROM clong l LEFT JOIN ctop t ON l.feature = t.feature AND l.value = t.value)
  GROUP BY ALL)""", "cluster_rows", clong=CLONG, ctop=CTOP))
def c3(spark, sf):
    return rounded(CL.categorical_profiles(X.cluster_rows(spark, sf), CAT))


DOM = """SELECT cluster, feature, value AS dominant_category, 100 * n / CAST(total AS DOUBLE) AS p FROM (SELECT cluster, feature, value, count(*) AS n, sum(count(*)) OVER (PARTITION BY cluster, feature) AS total,
  row_number() OVER (PARTITION BY cluster, feature ORDER BY count(*) DESC, value) AS k FROM clong WHERE value IS NOT NULL GROUP BY cluster, feature, value) WHERE k = 1"""


@query("c3_dominant_categories", sql(f"SELECT cluster, feature, dominant_category, {r('p')} AS dominant_percentage FROM dom", "cluster_rows", clong=CLONG, dom=DOM))
def c3_dominant(spark, sf):
    return rounded(CL.dominant_categories(X.cluster_rows(spark, sf), CAT))


@query("c4_distinctive_variables", sql(" UNION ALL ".join(f"""SELECT '{c}' AS feature, count(m) AS clusters, {r('CASE WHEN avg(m) <> 0 THEN stddev_pop(m) / avg(m) ELSE 0 END')} AS score
  FROM (SELECT avg({c}) AS m FROM cluster_rows GROUP BY cluster)""" for c in NUM), "cluster_rows"))
def c4(spark, sf):
    return rounded(CL.distinctive_variables(X.cluster_rows(spark, sf), NUM))


# clusters by nation group; prices of one cluster are doubled and its status fixed, so that insights appear
SHAPED = "SELECT cluster, CASE WHEN cluster = 1 THEN price * 2 ELSE price END AS price, CASE WHEN cluster = 2 THEN 'F' ELSE status END AS status FROM cluster_rows"
INSIGHT = f"""SELECT cluster, '' AS feature, 'size' AS kind, {r('100 * count(*) / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS value FROM shaped GROUP BY cluster UNION ALL
  SELECT cluster, 'price', 'numeric', {r('d')} FROM (SELECT cluster, (avg(price) / (SELECT avg(price) FROM shaped) - 1) * 100 AS d FROM shaped GROUP BY cluster) WHERE abs(d) > 20 UNION ALL
  SELECT cluster, 'status', 'categorical', {r('p')} FROM (SELECT cluster, 100 * max(n) / CAST(sum(n) AS DOUBLE) AS p FROM (SELECT cluster, status, count(*) AS n FROM shaped GROUP BY ALL) GROUP BY cluster) WHERE p > 70"""


@query("c5_cluster_insights", sql(INSIGHT, "cluster_rows", shaped=SHAPED))
def c5(spark, sf):
    df = X.cluster_rows(spark, sf).selectExpr("cluster", "CASE WHEN cluster = 1 THEN price * 2 ELSE price END AS price", "CASE WHEN cluster = 2 THEN 'F' ELSE status END AS status")
    return rounded(CL.insights(df, ["price"], ["status"]).select("cluster", "feature", "kind", "value"))


@query("c6_profile_model")
def c6(spark, sf):
    from featurelens.operators import models as M, transform as T
    df = X.labelled(spark, sf).select("price", "balance", "priority")
    pre = T.build_preprocessing(df, [], ["price", "balance"]).fit(df)
    model = M.clusterer("kmeans", 3, maxIter=10).fit(pre.transform(df))
    tables = CL.profile_clusters(model.transform(pre.transform(df)), ["price", "balance"], ["priority"])
    return tables["numeric"].join(tables["sizes"], "cluster")
