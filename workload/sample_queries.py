"""Splits, samples and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import balance as B, split as L
from featurelens.operators.profile import class_distribution
from featurelens.plans.pipeline import cross_validation_frame
from workload import fixtures as X
from workload.fixtures import sql, u_sql
from workload.registry import query, rounded


@query("b1_train_valid_test", f"""SELECT o_orderkey, CASE WHEN u < CAST(4e-1 AS DOUBLE) THEN 'train' WHEN u < CAST('0.7' AS DOUBLE) THEN 'valid' ELSE 'test' END AS dataset
  FROM (SELECT o_orderkey, {u_sql('o_orderkey')} AS u FROM orders)""")
def b1(spark, sf):
    parts = L.train_valid_test(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query("b2_clustering_split", f"""SELECT vec_id, CASE WHEN u < CAST('0.5' AS DOUBLE) THEN 'train' WHEN u < CAST('0.75' AS DOUBLE) THEN 'valid' ELSE 'test' END AS dataset
  FROM (SELECT vec_id, {u_sql('vec_id', seed=42)} AS u FROM embeddings)""")
def b2(spark, sf):
    return L.clustering_split(X.table(spark, sf, "embeddings").select("vec_id"), "vec_id", 0.4, 0.2, 0.2)


@query("b3_folds", f"SELECT l_orderkey, l_linenumber, CAST(floor({u_sql('l_orderkey', 'l_linenumber', seed=42)} * 5) AS INT) AS fold FROM lineitem")
def b3(spark, sf):
    return L.with_folds(X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 5)


@query("b4_oversample", sql(f"""SELECT event_id, target, unnest(range(0, 1 + CAST(floor(f) + CASE WHEN u < f - floor(f) THEN 1 ELSE 0 END AS BIGINT))) AS copy FROM (
  SELECT r.event_id, r.target, {u_sql('r.event_id')} AS u, CASE WHEN n / CAST(total AS DOUBLE) < 0.2 AND n < CAST(trunc(most * CAST('0.2' AS DOUBLE)) AS BIGINT)
    THEN (CAST(trunc(most * CAST('0.2' AS DOUBLE)) AS BIGINT) - n) / CAST(n AS DOUBLE) ELSE 0 END AS f
  FROM rare r JOIN (SELECT target, count(*) AS n, sum(count(*)) OVER () AS total, max(count(*)) OVER () AS most FROM rare GROUP BY target) c ON r.target = c.target)""", "rare"))
def b4(spark, sf):
    return B.oversample(X.rare(spark, sf), "target", "event_id", max_ratio=0.2).select("event_id", "target", "copy")


# synthetic rows stay inside the value range of their class and bring it to the asked size
@query("b5_smote", sql("SELECT true AS inside, true AS minority_only, true AS near_goal, CAST(floor(count(*) FILTER (target = 0) * CAST('0.06' AS DOUBLE)) AS BIGINT) - count(*) FILTER (target = 1) AS made FROM rare", "rare"))
def b5(spark, sf):
    df = X.rare(spark, sf)
    out = B.smote(df, "target", "event_id", ["value", "user_id"], max_ratio=0.06)
    span = df.where("target = 1").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    most = df.where("target = 0").count()
    made = out.where("synthetic")
    return made.agg(
        F.min(F.col("value").between(span["lo"], span["hi"])).alias("inside"), F.min(F.col("target") == 1).alias("minority_only"),
        (F.abs(F.count(F.lit(1)) - (int(most * 0.06) - span["n"])) <= 0.15 * most * 0.06).alias("near_goal"), F.count(F.lit(1)).alias("made"))


@query("b6_selection_sample", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {u_sql('l_orderkey', 'l_linenumber', seed=42)} < CAST('0.3' AS DOUBLE)")
def b6(spark, sf):
    return L.selection_sample(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "medium").select("l_orderkey", "l_linenumber")


@query("b7_large_table_sample", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {u_sql('l_orderkey', 'l_linenumber', seed=42)} < CAST('0.05' AS DOUBLE)")
def b7(spark, sf):
    return L.large_table_sample(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], 0.05).select("l_orderkey", "l_linenumber")


@query("u1_union_rows", "SELECT event_type, count(*) * 2 AS n FROM events GROUP BY event_type")
def u1(spark, sf):
    e = X.table(spark, sf, "events")
    return L.union_parts([e.select("event_id", "event_type"), e.select("event_type", "event_id")]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("u2_cross_validation_union", f"SELECT o_orderkey, CAST(floor({u_sql('o_orderkey', seed=42)} * 5) AS INT) AS fold FROM orders")
def u2(spark, sf):
    parts = L.train_valid_test(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return cross_validation_frame(list(parts.values()), "o_orderkey").select("o_orderkey", "fold")
