"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens import sources as S
from featurelens.operators import cluster_metrics as CM, models as M, profile as P
from featurelens.operators.shared import fresh_path
from featurelens.operators.transform import assemble, fit_preprocessor
from featurelens.sources.writers import write_assignments
from pyspark.ml import PipelineModel
from workload import fixtures as X
from workload.fixtures import sql, u_sql
from workload.registry import query, r, rounded

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("s1_load_source", "SELECT * FROM orders")
def s1(spark, sf):
    return S.load_source(spark, "orders", named={"orders": f"{sf}/orders.parquet"})[0]


def _written(spark, sf, fmt: str, **options) -> str:
    path = fresh_path(spark, fmt)
    X.table(spark, sf, "customer").write.options(**options).format(fmt).save(path)
    return path


@query("s2_csv_scan", CUSTOMER_SQL)
def s2(spark, sf):
    return S.read_csv(spark, _written(spark, sf, "csv", header=True), schema=CUSTOMER_SCHEMA)


@query("s3_tsv_scan", CUSTOMER_SQL)
def s3(spark, sf):
    return S.read_tsv(spark, _written(spark, sf, "csv", header=True, sep="\t"))


@query("s4_json_scan", CUSTOMER_SQL)
def s4(spark, sf):
    return S.read_json(spark, _written(spark, sf, "json"), schema=CUSTOMER_SCHEMA)


@query("s5_parquet_scan", "SELECT l_returnflag, l_quantity FROM lineitem WHERE l_quantity > 45")
def s5(spark, sf):
    return S.read_parquet(spark, f"{sf}/lineitem.parquet").where("l_quantity > 45").select("l_returnflag", "l_quantity")


@query("s6_csv_by_uri", CUSTOMER_SQL)
def s6(spark, sf):
    return S.load_source(spark, _written(spark, sf, "csv", header=True), "csv", infer=True)[0]


@query("s8_table_scan", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders WHERE o_orderstatus = 'F'")
def s8(spark, sf):
    X.table(spark, sf, "orders").createOrReplaceTempView("featurelens_orders")
    df, _ = S.load_source(spark, "featurelens_orders", "table")
    return S.read_with_options(df, ["o_orderkey", "o_totalprice * 2 AS doubled"], "o_orderstatus = 'F'")


@query("s9_query_options", "SELECT event_type, value FROM events WHERE value > 100")
def s9(spark, sf):
    return S.read_with_options(X.table(spark, sf, "events"), ["event_type", "value"], "value > 100", sample_percent=100)


@query("s10_filtered_table", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def s10(spark, sf):
    return S.materialise_filtered(X.table(spark, sf, "lineitem"), "l_returnflag = 'R'", ["l_orderkey", "l_quantity"])


# a table within the row limit stays whole, a larger one is capped
@query("s11_working_sample", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {u_sql('l_orderkey', 'l_linenumber', seed=42)} < CAST('0.1' AS DOUBLE)")
def s11(spark, sf):
    return S.working_sample(X.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("s12_pruned_reload", "SELECT o_orderstatus, o_orderpriority, o_totalprice FROM orders WHERE o_totalprice > 1000")
def s12(spark, sf):
    return S.reload_selected(X.table(spark, sf, "orders"), ["o_orderpriority_encoded", "o_totalprice"], "o_orderstatus", "o_totalprice > 1000")


@query("s13_later_datasets", "SELECT 'train' AS dataset, count(*) AS n FROM orders UNION ALL SELECT 'oot1', count(*) FROM orders")
def s13(spark, sf):
    got = S.load_datasets(spark, {"train": f"{sf}/orders.parquet", "oot1": X.table(spark, sf, "orders")})
    return P.tag_datasets(got).groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))


@query("s14_preview", "SELECT * FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2, 'n_regionkey', 'int')) t(position, column_name, data_type), "
       "(SELECT count(*) AS row_count FROM nation)")
def s14(spark, sf):
    return S.readers.preview_table(X.table(spark, sf, "nation")).withColumnRenamed("column", "column_name")


@query("s15_prediction_sink", sql("SELECT dataset, count(*) AS n, sum(label) AS positives, sum(prediction) AS predicted FROM scored GROUP BY dataset", "scored"))
def s15(spark, sf):
    path = fresh_path(spark, "predictions")
    df = X.scored(spark, sf)
    names = ["train", "oot1", "oot2"]
    S.write_predictions({n: df.where(F.col("dataset") == n) for n in names}, path, ["label", "prediction", "score"])
    back = P.tag_datasets({n: spark.read.parquet(f"{path}/{n}") for n in names})
    return back.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.sum("prediction").alias("predicted"))


@query("s16_assignment_sink", "SELECT label AS prediction, count(*) AS n FROM embeddings GROUP BY label")
def s16(spark, sf):
    from pyspark.ml.functions import array_to_vector
    path = fresh_path(spark, "assignments")
    write_assignments(X.clustered(spark, sf).withColumn("features", array_to_vector("features")), path)
    back = S.read_csv(spark, path, schema="vec_id bigint, features string, prediction int", escape='"')
    return back.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))


@query("s17_profile_sink", "SELECT 'l_quantity' AS feature, count(l_quantity) AS count, " + r("avg(l_quantity)") + " AS mean FROM lineitem")
def s17(spark, sf):
    path = fresh_path(spark, "profile")
    S.write_profile({"numeric": P.numeric_univariate(X.table(spark, sf, "lineitem"), ["l_quantity"])}, path)
    return rounded(spark.read.json(f"{path}/numeric").select("feature", "count", "mean"))


@query("s18_model_persistence", sql("SELECT count(*) AS n, count(DISTINCT key) AS same, 'classification' AS task FROM labelled", "labelled"))
def s18(spark, sf):
    df = X.labelled(spark, sf).select("key", "price", "balance", "priority", "target")
    pre = fit_preprocessor(df, "target", exclude=["key"])
    model = M.classifier("logistic", label="target", maxIter=5).fit(pre.transform(df))
    path = fresh_path(spark, "model")
    whole = PipelineModel([*pre.model.stages, model])
    S.save_model(spark, whole, path, {"task": "classification"})
    again, meta = S.load_model(spark, path)
    a = whole.transform(df).select("key", F.col("prediction").alias("a"))
    b = again.transform(df).select("key", F.col("prediction").alias("b"))
    return a.join(b, "key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"), F.lit(meta["task"]).alias("task"))
