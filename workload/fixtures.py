"""Input frames of the queries, each with its SQL text. All derive from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from featurelens.functions.expressions import unit_hash


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def u_sql(*keys: str, seed: int = 12345) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(CAST('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


# select lists readable by both engines
GAPS = [
    "o_orderkey AS key",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS num",
    "CASE WHEN o_orderkey % 11 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS cat",
    "CASE WHEN o_orderkey % 5 = 0 THEN '$' || CAST(o_custkey AS STRING) || ' usd' WHEN o_orderkey % 5 = 1 THEN '?' WHEN o_orderkey % 5 = 2 THEN 'NA' "
    "WHEN o_orderkey % 5 = 3 THEN CAST(o_custkey AS STRING) ELSE '-' || CAST(o_custkey AS STRING) || '.5' END AS txt",
    "1 AS const",
    "CASE WHEN o_orderkey % 5 <> 0 THEN NULL ELSE o_custkey END AS mostly_null",
    "CAST(o_custkey AS STRING) AS customer",
    "CAST(CAST(o_orderdate AS DATE) AS STRING) AS order_date_text",
    "o_orderstatus AS status_time",
    "o_totalprice > 250000 AS flag",
    "o_orderdate AS ts",
]
LABELLED = [
    "o_orderkey AS key", "o_orderdate AS odate", "o_orderstatus AS status", "o_totalprice AS base_price", "c_acctbal AS balance",
    "o_orderpriority AS priority", "c_mktsegment AS segment", "CAST(c_nationkey AS INT) AS nation",
    "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target",
    "CASE WHEN o_orderdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-06-01 00:00:00' THEN 'oot1' ELSE 'oot2' END AS dataset",
]
# the latest dataset has shifted prices, gaps in one column and a rare priority
LABELLED_MORE = ["*", "CASE WHEN dataset = 'oot2' THEN base_price * 12e-1 ELSE base_price END AS price",
                 "CASE WHEN dataset = 'oot2' AND key % 8 = 0 THEN NULL ELSE segment END AS segment_gaps"]
RARE = ["event_id", "value", "event_type", "user_id", "CASE WHEN value > 180 THEN 1 ELSE 0 END AS target"]
PRICED = [
    "l_orderkey AS okey", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp", "l_quantity AS quantity", "l_discount AS discount", "l_tax AS tax", "l_returnflag AS flag", "l_linestatus AS status",
    "l_extendedprice AS target", "l_quantity * 15e2 * (1 - l_discount) AS prediction",
    "CASE WHEN l_shipdate < TIMESTAMP '1999-01-01 00:00:00' THEN 'train' ELSE 'oot1' END AS dataset",
]

GAPS_SQL = f"SELECT {', '.join(GAPS)} FROM orders"
LABELLED_SQL = (f"SELECT {', '.join(LABELLED_MORE)} FROM (SELECT {', '.join(LABELLED)} FROM orders JOIN customer ON o_custkey = c_custkey)")
RARE_SQL = f"SELECT {', '.join(RARE)} FROM events"
PRICED_SQL = f"SELECT {', '.join(PRICED)} FROM lineitem"
BLEND = "floor(least(CAST(1 AS DOUBLE), (CAST(1 AS DOUBLE) - w) * u + w * target) * 100) / 100"
SCORED_SQL = (f"SELECT key, dataset, target AS label, score, CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS prediction, u "
              f"FROM (SELECT *, {BLEND} AS score FROM (SELECT *, 3e-1 AS w, {u_sql('key')} AS u FROM labelled))")
MODELS = [("alpha", 0.1), ("beta", 0.2), ("delta", 0.25), ("gamma", 0.3)]
MODELS_SQL = ("SELECT model, key, dataset, target AS label, score, CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS prediction, u "
              f"FROM (SELECT *, {BLEND} AS score FROM (SELECT l.*, m.model, CAST(m.w AS DOUBLE) AS w, {u_sql('m.model', 'key')} AS u FROM labelled l, "
              f"(VALUES {', '.join(str(m) for m in MODELS)}) m(model, w)))")
CLUSTERED_SQL = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS prediction FROM embeddings"
KTABLE_SQL = "SELECT k, vec_id, x, prediction % k AS prediction FROM clustered, (SELECT unnest([2, 3, 4, 5, 6, 7]) AS k)"


def gaps(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(*GAPS)


def labelled(spark, sf) -> DataFrame:
    # customers grow with the orders: every action on these rows would send them through the driver again
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.selectExpr(*LABELLED).selectExpr(*LABELLED_MORE)


def rare(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*RARE)


def priced(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*PRICED)


def scored(spark, sf) -> DataFrame:
    base = labelled(spark, sf).withColumn("w", F.lit(0.3)).withColumn("u", unit_hash("key"))
    out = base.selectExpr("*", f"{BLEND} AS score")
    return out.selectExpr("key", "dataset", "target AS label", "score", "CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS prediction")


def scored_models(spark, sf) -> DataFrame:
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(w).alias("w")) for m, w in MODELS])
    base = labelled(spark, sf).select("*", F.inline(models)).withColumn("u", unit_hash("model", "key"))
    out = base.selectExpr("*", f"{BLEND} AS score")
    return out.selectExpr("model", "key", "dataset", "target AS label", "score", "CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS prediction")


def clustered(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("prediction"))


def k_tables(spark, sf) -> DataFrame:
    ks = F.array(*[F.lit(k) for k in range(2, 8)])
    return clustered(spark, sf).withColumn("k", F.explode(ks)).withColumn("prediction", F.col("prediction") % F.col("k"))


def cluster_rows(spark, sf) -> DataFrame:
    """Orders with their nation as the cluster label."""
    return labelled(spark, sf).withColumn("cluster", F.col("nation") % 5)


CLUSTER_ROWS_SQL = "SELECT *, nation % 5 AS cluster FROM labelled"

CTES = {
    "gaps": ("gaps", GAPS_SQL, []), "labelled": ("labelled", LABELLED_SQL, []), "rare": ("rare", RARE_SQL, []),
    "priced": ("priced", PRICED_SQL, []), "scored": ("scored", SCORED_SQL, ["labelled"]), "scored_models": ("scored_models", MODELS_SQL, ["labelled"]),
    "clustered": ("clustered", CLUSTERED_SQL, []), "k_tables": ("k_tables", KTABLE_SQL, ["clustered"]),
    "cluster_rows": ("cluster_rows", CLUSTER_ROWS_SQL, ["labelled"]),
}


def sql(body: str, *fixtures: str, **more: str) -> str:
    """``body`` behind the fixtures (and further named texts) as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][2]:
            add(dep)
        if name not in order:
            order.append(name)

    for f in fixtures:
        add(f)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({text})" for n, text in more.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
