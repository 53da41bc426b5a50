"""P1-P14, J1-J4, T: column decisions, cleaning and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import columns as C, joins as J, transform as T
from workload import fixtures as X
from workload.fixtures import sql, u_sql
from workload.registry import query, r, rounded
from workload.profile_queries import MISSING_SQL

FEATURES = ["num", "cat", "txt", "const", "mostly_null", "customer", "order_date_text", "status_time", "flag", "ts"]


@query("p1_pick_columns", "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate FROM lineitem")
def p1(spark, sf):
    li = X.table(spark, sf, "lineitem")
    return li.select(C.pick_columns(li.columns, include_prefix=["l_"], exclude=["l_tax"], exclude_suffix=["key", "number", "status"]))


@query("p2_date_columns", sql(
    "SELECT 'ts' AS column_name, false AS kept UNION ALL "
    "SELECT 'order_date_text', avg(CAST(regexp_matches(order_date_text, '\\d{4}-\\d{2}-\\d{2}') AS INT)) <= 0.5 FROM gaps UNION ALL "
    "SELECT 'status_time', avg(CAST(regexp_matches(status_time, '\\d{4}-\\d{2}-\\d{2}') AS INT)) <= 0.5 FROM gaps UNION ALL "
    "SELECT unnest(['num', 'cat', 'txt', 'const', 'mostly_null', 'customer', 'flag']), true", "gaps"))
def p2(spark, sf):
    dates = C.date_columns(X.gaps(spark, sf), FEATURES)
    d = C.decisions(spark, FEATURES, [c for c in FEATURES if c not in dates], "date column")
    return d.select(F.col("column").alias("column_name"), "kept")


P3_COLUMNS = ["num", "cat", "txt", "const", "mostly_null", "customer"]


@query("p3_missing_filter", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({MISSING_SQL[c]}) / CAST(count(*) AS DOUBLE) <= 0.75 AS kept FROM gaps" for c in P3_COLUMNS), "gaps"))
def p3(spark, sf):
    g = X.gaps(spark, sf)
    d = C.decisions(spark, P3_COLUMNS, C.low_missing_columns(g, P3_COLUMNS), "missing")
    return d.select(F.col("column").alias("column_name"), "kept")


ORDER_KINDS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_totalprice": "numeric", "o_orderdate": "numeric", "o_orderstatus": "categorical", "o_orderpriority": "categorical"}


# the kind of every column beside what its rows hold
@query("p4_split_kinds", " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{k}' AS kind, count({c}) AS present, count(DISTINCT {c}) AS distinct_values FROM orders" for c, k in ORDER_KINDS.items()))
def p4(spark, sf):
    orders = X.table(spark, sf, "orders")
    cats, nums = C.split_by_kind(orders)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.count(c).alias("present"), F.countDistinct(c).alias("distinct_values"))
            for k, cols in (("categorical", cats), ("numeric", nums)) for c in cols]
    return orders.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


@query("p5_cardinality_filter", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) FILTER (NOT ({MISSING_SQL[c]})) <= 50 AS kept FROM gaps" for c in ["cat", "txt", "customer"]), "gaps"))
def p5(spark, sf):
    cols = ["cat", "txt", "customer"]
    d = C.decisions(spark, cols, C.low_cardinality_columns(X.gaps(spark, sf), cols, exact=True), "cardinality")
    return d.select(F.col("column").alias("column_name"), "kept")


@query("p6_text_to_number", sql(
    "SELECT key, CASE WHEN trim(txt) NOT IN ('', '?', 'NA', 'NULL') THEN TRY_CAST(regexp_replace(txt, '[^0-9.-]', '', 'g') AS DOUBLE) END AS txt FROM gaps", "gaps"))
def p6(spark, sf):
    return C.coerce_columns(X.gaps(spark, sf).select("key", "txt"), ["txt"])


@query("p7_clean_target", sql("SELECT key, num FROM gaps WHERE num IS NOT NULL AND NOT isnan(num)", "gaps"))
def p7(spark, sf):
    return C.clean_numeric_target(X.gaps(spark, sf).select("key", "num"), "num")


@query("p8_clean_predictions", sql("SELECT key, num AS target, mostly_null AS prediction FROM gaps WHERE num IS NOT NULL AND NOT isnan(num) AND mostly_null IS NOT NULL", "gaps"))
def p8(spark, sf):
    return C.clean_predictions(X.gaps(spark, sf).selectExpr("key", "num AS target", "mostly_null AS prediction"), "target")


@query("p9_row_sample", f"SELECT o_orderkey FROM orders WHERE {u_sql('o_orderkey', seed=42)} < CAST('0.3' AS DOUBLE)")
def p9(spark, sf):
    return C.sample_rows(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.3)


@query("p10_numeric_gate", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def p10(spark, sf):
    lines = X.table(spark, sf, "lineitem")
    return lines.select(*C.numeric_columns(lines))


@query("p11_clustering_columns", "SELECT o_totalprice, o_orderpriority FROM orders")
def p11(spark, sf):
    df = X.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS row_id", "o_totalprice", "o_orderpriority", "o_orderdate")
    cats, nums = C.clustering_columns(df)
    return df.select(*nums, *cats)


@query("p12_encoded_names", "SELECT o_orderkey AS a_encoded, o_custkey AS b_encoded, o_totalprice FROM orders")
def p12(spark, sf):
    df = X.table(spark, sf, "orders").selectExpr("o_orderkey AS a_index", "o_custkey AS b_index", "o_totalprice")
    return C.rename_encoded(df, ["a", "b"])


@query("p13_suggest_target", sql("""SELECT 'classification' AS task, CASE WHEN (SELECT count(DISTINCT o_orderkey) FROM orders) = 2 THEN 'o_orderkey'
  WHEN (SELECT count(DISTINCT o_custkey) FROM orders) = 2 THEN 'o_custkey' WHEN (SELECT count(DISTINCT o_totalprice > 250000) FROM orders) = 2 THEN 'expensive'
  ELSE 'o_orderstatus' END AS suggestion UNION ALL SELECT 'regression', 'o_orderkey'"""))
def p13(spark, sf):
    df = X.table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice > 250000 AS expensive", "o_orderpriority")
    return spark.createDataFrame([(t, C.suggest_target(df, t)) for t in ("classification", "regression")], "task string, suggestion string")


FREQ = ("SELECT {c} AS value, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS code, count(*) OVER () AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}")


@query("p14_encoded_only", sql("SELECT key, price, CAST(p.code AS DOUBLE) AS priority_encoded, target FROM labelled JOIN pc p ON priority = p.value", "labelled",
                               pc=FREQ.format(c="priority", t="labelled")))
def p14(spark, sf):
    df = X.labelled(spark, sf)
    coded = T.index_categoricals(df, ["priority"]).transform(df)
    return C.keep_encoded(coded, ["price", "priority_encoded"], "target", ["key"])


@query("j1_join_by_key", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, sf):
    o = X.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey"))
    c = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    return J.join_by_key(o, c, ["custkey"]).select("o_orderkey", "c_mktsegment")


# every third row shares one key: only that key is salted
@query("j1_salted_join", """SELECT o_orderkey, c_mktsegment FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS k FROM orders)
  JOIN customer ON k = c_custkey""")
def j1_salted(spark, sf):
    o = X.table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey END AS k")
    c = X.table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_mktsegment")
    return J.salted_join(o, c, ["k"], salt_over=0).select("o_orderkey", "c_mktsegment")


@query("j2_attach_labels", "SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j2(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    return J.attach_labels(docs, X.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("j3_attach_predictions", sql("SELECT l.key, l.segment, s.prediction FROM labelled l JOIN scored s ON l.key = s.key", "scored"))
def j3(spark, sf):
    return J.attach_labels(X.labelled(spark, sf).select("key", "segment"), X.scored(spark, sf).select("key", "prediction"), "key")


def shares(dataset: str) -> str:
    return (f"SELECT segment_gaps AS bin, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM labelled WHERE dataset = '{dataset}' "
            "AND segment_gaps IS NOT NULL GROUP BY 1")


@query("j4_align_distributions", sql(
    f"SELECT coalesce(e.bin, a.bin) AS bin, {r('coalesce(e.share, 0)')} AS expected, {r('coalesce(a.share, 0)')} AS actual FROM e FULL JOIN a ON e.bin = a.bin",
    "labelled", e=shares("train") + " HAVING segment_gaps <> 'BUILDING'", a=shares("oot1") + " HAVING segment_gaps <> 'MACHINERY'"))
def j4(spark, sf):
    base = X.labelled(spark, sf).where(F.col("segment_gaps").isNotNull())

    def side(dataset: str, without: str):
        d = base.where((F.col("dataset") == dataset) & (F.col("segment_gaps") != without))
        n = d.count()
        return d.groupBy(F.col("segment_gaps").alias("bin")).agg((F.count(F.lit(1)) / n).alias("share"))

    return rounded(J.align_distributions(side("train", "BUILDING"), side("oot1", "MACHINERY"), ["bin"]))


@query("t1_top_categories", """SELECT value, count, rank FROM (SELECT l_returnflag || l_linestatus AS value, count(*) AS count,
  row_number() OVER (ORDER BY count(*) DESC, l_returnflag || l_linestatus) AS rank FROM lineitem GROUP BY 1) WHERE rank <= 3""")
def t1(spark, sf):
    from featurelens.operators.profile import top_values
    df = X.table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("flags"))
    return top_values(df, ["flags"], n=3).drop("feature")


@query("t3_first_rows", "SELECT least(count(*), 25) AS n, least(count(DISTINCT o_orderkey), 25) AS orders FROM orders")
def t3(spark, sf):
    from featurelens.sources import read_with_options
    return read_with_options(X.table(spark, sf, "orders"), limit=25).join(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("orders"))
