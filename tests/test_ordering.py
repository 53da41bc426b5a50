import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import ordering as O
from featurelens.operators.joins import align_distributions, attach_labels, salted_join
from featurelens.operators.quantiles import _located, exact_quantiles, quantile_columns


def values(spark, n=4000, parts=3):
    rng = random.Random(1)
    # a third of the rows share one value
    rows = [("a" if i % 5 else "b", 7.0 if rng.random() < 0.34 else round(rng.gauss(0, 5), 3)) for i in range(n)]
    return spark.createDataFrame(rows, "g string, v double").repartition(parts), rows


@pytest.mark.parametrize("bound", [1_000_000, 40])
@pytest.mark.parametrize("parts", [1, 3, 17])
def test_quantiles_equal_numpy(spark, bound, parts):
    df, rows = values(spark, parts=parts)
    probs = [0.0, 0.1, 0.25, 0.5, 0.66, 0.75, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in exact_quantiles(df, ["g"], "v", probs, ordered_rows=bound).collect()}
    for g in "ab":
        v = np.array([x for k, x in rows if k == g])
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(v, p), abs=1e-9)


def test_quantiles_narrow_until_bounded(spark):
    df = spark.range(200_000).select((F.col("id") * 0.5).alias("v"))
    got = {r["p"]: r["q"] for r in exact_quantiles(df, [], "v", [0.25, 0.5], ordered_rows=20).collect()}
    v = np.arange(200_000) * 0.5
    assert got == {0.25: np.quantile(v, 0.25), 0.5: np.quantile(v, 0.5)}


def test_bounded_quantiles_keep_null_groups_and_single_rows(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit("a")).alias("g"), (F.col("id") * 37 % 3000).cast("double").alias("v"))
    out = exact_quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0], ordered_rows=30)
    for g in (None, "a"):
        v = np.array([r["v"] for r in df.where(F.col("g").eqNullSafe(F.lit(g))).collect()])
        assert {r["p"]: r["q"] for r in out.where(F.col("g").eqNullSafe(F.lit(g))).collect()} == pytest.approx({p: np.quantile(v, p) for p in (0.0, 0.3, 0.5, 1.0)})
    cells = _located(df.withColumnRenamed("v", "_v"), {(None,): {10.0, 20.0}, ("a",): {10.0, 15.0, 20.0}}, ["g"], lambda rows, c: spark.createDataFrame(rows, f"g string, {c[0]} array<double>"))
    got = {(r["g"], r["_v"]): r["_cell"] for r in cells.collect()}
    assert len(got) == 3000
    for (g, v), cell in got.items():
        edges = [10.0, 20.0] if g is None else [10.0, 15.0, 20.0]
        assert cell == 2 * sum(e <= v for e in edges) - (v in edges)
    plan = exact_quantiles(df, [], "v", [0.5], ordered_rows=30)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_quantiles_without_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(df, ["g"], "v", [0.5]).count() == 0
    one = spark.createDataFrame([("a", 3.0), ("a", None)], "g string, v double")
    assert quantile_columns(exact_quantiles(one, ["g"], "v", [0.25, 0.75]), ["g"], {0.25: "x", 0.75: "y"}).first()["y"] == 3.0


@pytest.mark.parametrize("rows_per_task", [10_000_000, 300])
def test_row_numbers_and_deciles_equal_sql(spark, rows_per_task):
    df = spark.range(3001).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"),
                                  F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.round(F.abs(F.sin(F.col("id").cast("double"))), 2)).alias("s"))
    got = O.ntiles(df, "s", ["k"], ["g"], 10, rows_per_task=rows_per_task).select("k", "row_number", "decile")
    df.withColumn("u", __import__("featurelens.functions.expressions", fromlist=["unit_hash"]).unit_hash("k")).createOrReplaceTempView("t")
    want = spark.sql("SELECT k, row_number() OVER w AS row_number, ntile(10) OVER w AS decile FROM t WINDOW w AS (PARTITION BY g ORDER BY s DESC, u, k)")
    assert got.exceptAll(want.selectExpr("k", "CAST(row_number AS BIGINT)", "decile")).count() == 0
    assert got.count() == 3001


def test_ranges_split_a_hot_score(spark):
    df = spark.range(9000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 9000).alias("s"))
    cuts, hot, _, _ = O._score_ranges(df, "s", 300)
    assert list(hot) == [0.5] and hot[0.5] >= 8


def test_approximate_deciles_are_even(spark):
    df = spark.range(10_000).select((F.col("id") / 10_000).alias("s"))
    sizes = [r["count"] for r in O.approximate_ntiles(df, "s").groupBy("decile").count().collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 40


def test_salted_join_equals_plain_join(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 700).alias("k"), F.col("id").alias("x"))
    right = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    for how in ("inner", "left"):
        a, b = salted_join(left, right, ["k"], how, salt_over=0), left.join(right, ["k"], how)
        assert a.count() == b.count() and a.select("k", "x", "y").exceptAll(b.select("k", "x", "y")).count() == 0
    with pytest.raises(ValueError):
        salted_join(left, right, ["k"], "full_outer")


@pytest.mark.parametrize("attach", [lambda a, b: salted_join(a, b, ["k"], "left", salt_over=0), lambda a, b: attach_labels(a, b, "k")])
def test_null_keys_are_dealt_over_tasks(spark, attach):
    left = spark.range(8000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(8000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")).unionByName(
        spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 5L AS y"))
    keep = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(keep, ("-1", "false", "16")):
            spark.conf.set(c, v)
        out = attach(left, right)
        assert out.columns == ["k", "x", "y"]
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert out.exceptAll(left.join(right, ["k"], "left")).count() == 0 and sum(sizes) == 8000
        assert max(sizes) < 2000
    finally:
        for c, v in keep.items():
            spark.conf.set(c, v)


def test_alignment_keeps_both_sides(spark):
    a = spark.createDataFrame([("x", 0.4), ("y", 0.6)], "bin string, share double")
    b = spark.createDataFrame([("y", 0.5), ("z", 0.5)], "bin string, share double")
    assert {r["bin"]: (r["expected"], r["actual"]) for r in align_distributions(a, b, ["bin"]).collect()} == {
        "x": (0.4, 0.0), "y": (0.6, 0.5), "z": (0.0, 0.5)}


def test_numbered_text_in_ranges(spark):
    names = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(5)
    got = {r["name"]: r["at"] for r in O.numbered(df, "name", "at").collect()}
    assert [got[n] for n in sorted(names)] == list(range(1000))
    assert O.numbered(df.limit(0), "name", "at").count() == 0
