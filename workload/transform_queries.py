"""Indexing, imputation, scaling and the fitted preprocessing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from featurelens.operators import columns as C, transform as T
from workload import fixtures as X
from workload.fixtures import sql
from workload.registry import query, r, rounded


def freq(c: str, t: str, where: str = "true", clean: str | None = None) -> str:
    v = clean or c
    return f"SELECT {v} AS value, row_number() OVER (ORDER BY count(*) DESC, {v}) - 1 AS code FROM {t} WHERE {v} IS NOT NULL AND {where} GROUP BY {v}"


# codes of train; values unknown to train and nulls share the next code
@query("f1_index_categoricals", sql(
    "SELECT key, CAST(coalesce(s.code, (SELECT count(*) FROM sc)) AS DOUBLE) AS segment_gaps_encoded, CAST(coalesce(p.code, (SELECT count(*) FROM pc)) AS DOUBLE) AS priority_encoded "
    "FROM labelled l LEFT JOIN sc s ON l.segment_gaps = s.value LEFT JOIN pc p ON l.priority = p.value", "labelled",
    sc=freq("segment_gaps", "labelled", "dataset = 'train'"), pc=freq("priority", "labelled", "dataset = 'train' AND priority <> '1-URGENT'")))
def f1(spark, sf):
    df = X.labelled(spark, sf)
    train = df.where("dataset = 'train'")
    a = T.index_categoricals(train, ["segment_gaps"])
    b = T.index_categoricals(train.where("priority <> '1-URGENT'"), ["priority"])
    return b.transform(a.transform(df)).select("key", "segment_gaps_encoded", "priority_encoded")


@query("f2_index_target", "SELECT o_orderkey, CAST(code AS DOUBLE) AS label, o_orderstatus AS predicted_o_orderstatus FROM orders JOIN ("
       + freq("o_orderstatus", "orders") + ") ON o_orderstatus = value")
def f2(spark, sf):
    df = X.table(spark, sf, "orders")
    model, inverse = T.index_target(df, "o_orderstatus")
    return inverse.transform(model.transform(df).withColumn("prediction", F.col("label"))).select("o_orderkey", "label", "predicted_o_orderstatus")


@query("f3_impute", sql("SELECT key, CASE WHEN num IS NULL OR isnan(num) THEN CAST(-999 AS DOUBLE) ELSE num END AS num, "
                        "coalesce(CAST(mostly_null AS DOUBLE), -999) AS mostly_null FROM gaps", "gaps"))
def f3(spark, sf):
    return T.impute_constant(X.gaps(spark, sf).select("key", "num", "mostly_null"), ["num", "mostly_null"], -999)


@query("f4_assemble", "SELECT l_orderkey, l_linenumber, l_quantity AS a, l_discount AS b FROM lineitem")
def f4(spark, sf):
    df = T.assemble(X.table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    v = vector_to_array("features")
    return df.select("l_orderkey", "l_linenumber", v.getItem(0).alias("a"), v.getItem(1).alias("b"))


SCALE_SQL = ("SELECT okey, line, " + r("quantity / (SELECT stddev_samp(quantity) FROM priced WHERE dataset = 'train')") + " AS quantity_scaled, "
             + r("tax / (SELECT stddev_samp(tax) FROM priced WHERE dataset = 'train')") + " AS tax_scaled FROM priced WHERE dataset IN ({d})")


def _scaled(spark, sf, fit_on: str, apply_to: str):
    df = X.priced(spark, sf)
    model = T.fit_scaler(df.where(F.col("dataset") == fit_on), ["quantity", "tax"])
    out = T.scaled_columns(model.transform(df.where(apply_to)), ["quantity", "tax"])
    return rounded(out.select("okey", "line", "quantity_scaled", "tax_scaled"))


@query("f5_scale_train", sql(SCALE_SQL.format(d="'train'"), "priced"))
def f5(spark, sf):
    return _scaled(spark, sf, "train", "dataset = 'train'")


@query("f6_scale_all", sql(SCALE_SQL.format(d="'train', 'oot1'"), "priced"))
def f6(spark, sf):
    return _scaled(spark, sf, "train", "true")


_G = "SELECT *, CASE WHEN trim(cat) <> '' THEN cat END AS c, CASE WHEN trim(txt) NOT IN ('', '?', 'NA', 'NULL') THEN TRY_CAST(regexp_replace(txt, '[^0-9.-]', '', 'g') AS DOUBLE) END AS t FROM gaps"
PREPARED = ("SELECT key, CAST(coalesce(f.code, (SELECT count(*) FROM fc)) AS DOUBLE) AS cat_encoded, CASE WHEN num IS NULL OR isnan(num) THEN CAST(-999 AS DOUBLE) ELSE num END AS num, "
            "CAST(const AS DOUBLE) AS const, CASE WHEN flag THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS flag FROM g LEFT JOIN fc f ON g.c = f.value WHERE {w}")


def _preprocessor(spark, sf, train_where: str):
    g = X.gaps(spark, sf).withColumn("target", F.col("key") % 2)
    pre = T.fit_preprocessor(g.where(train_where), "target", exclude=["key", "status_time", "txt"], exact=True)
    return g, pre


@query("f7_apply_preprocessing", sql(PREPARED.format(w="true"), "gaps", g=_G, fc=freq("c", "g", "key % 3 <> 0")))
def f7(spark, sf):
    g, pre = _preprocessor(spark, sf, "key % 3 <> 0")
    return T.encoded_frame(pre, g.drop("target"), ["key"]).select("key", "cat_encoded", "num", "const", "flag")


@query("f8_scale_new_rows", sql(
    f"SELECT key, {r('q.num / (SELECT stddev_samp(num) FROM prep WHERE key % 3 <> 0)')} AS num_scaled FROM prep q", "gaps", g=_G, fc=freq("c", "g", "key % 3 <> 0"),
    prep=PREPARED.format(w="true")))
def f8(spark, sf):
    g, pre = _preprocessor(spark, sf, "key % 3 <> 0")
    at = pre.feature_columns.index("num")
    return rounded(pre.transform(g).select("key", vector_to_array("features").getItem(at).alias("num_scaled")))


@query("f9_later_data", sql("SELECT q.key, cat_encoded, num, const, flag, q.key % 2 AS target FROM prep q", "gaps", g=_G, fc=freq("c", "g", "key % 3 <> 0"),
                            prep=PREPARED.format(w="key % 3 = 0")))
def f9(spark, sf):
    g, pre = _preprocessor(spark, sf, "key % 3 <> 0")
    out = T.prepare_later_data(pre, g.where("key % 3 = 0"), ["key"])
    return out.select("key", "cat_encoded", "num", "const", "flag", "target")


@query("f10_preprocess", sql("SELECT q.key, cat_encoded, num, const, flag, q.key % 2 AS target FROM prep q", "gaps", g=_G, fc=freq("c", "g"), prep=PREPARED.format(w="true")))
def f10(spark, sf):
    g, pre = _preprocessor(spark, sf, "true")
    return T.encoded_frame(pre, g, ["key"]).select("key", "cat_encoded", "num", "const", "flag", "target")


@query("f11_unsupervised", sql("SELECT count(*) AS n, count(DISTINCT key) AS keys, count(*) AS same_width FROM gaps", "gaps"))
def f11(spark, sf):
    df = X.gaps(spark, sf).drop("ts", "order_date_text", "customer")
    cats, nums = C.clustering_columns(df.drop("key"))
    model = T.build_preprocessing(df, cats, nums).fit(df)
    out = model.transform(df)
    return out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"), F.count_if(F.size(vector_to_array("features")) == len(cats) + len(nums)).alias("same_width"))
