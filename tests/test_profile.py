import math

import pytest
from pyspark.sql import functions as F

from featurelens.operators import clusters as CL, columns as C, compare as K, correlate as R, drift as D, profile as P

SCHEMA = "k bigint, num double, cat string, flag boolean"


@pytest.fixture(scope="module")
def small(spark):
    rows = [(1, 1.0, "a", True), (2, None, " ", False), (3, math.nan, None, True), (4, 4.0, "b", None), (5, 4.0, "a", True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_feature(df):
    return {r["feature"]: r.asDict() for r in df.collect()}


def test_missing_policy(small):
    m = by_feature(P.missing_counts(small))
    assert [m[c]["missing_count"] for c in ("k", "num", "cat", "flag")] == [0, 2, 2, 1]
    assert by_feature(P.exact_cardinality(small, ["cat", "num"]))["cat"]["unique_count"] == 2


def test_univariate_modes_agree_on_small_data(small):
    a, b = by_feature(P.numeric_univariate(small, ["num"], exact=True)), by_feature(P.numeric_univariate(small, ["num"]))
    assert a["num"]["mean"] == b["num"]["mean"] == 3.0 and a["num"]["median"] == 4.0


def test_profile_of_no_rows_and_one_row(spark, small):
    empty = small.where("false")
    p = by_feature(P.univariate_profile(empty, ["num", "cat"], exact=True))
    assert p["num"]["total_rows"] == 0 and p["num"]["missing_percentage"] is None
    one = by_feature(P.univariate_profile(small.where("k = 1"), ["num"], exact=True))
    assert one["num"]["grade"] == "F" and list(one["num"]["warnings"]) == ["constant_feature:critical"]


def test_nested_columns_are_refused(spark):
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    with pytest.raises(TypeError):
        P.univariate_profile(df)
    with pytest.raises(TypeError):
        C.split_by_kind(df)


def test_bins_cover_all_rows_and_missing_has_its_own(spark, small):
    n = P.numeric_by_class(small, ["num"], "flag", exact=True)
    assert n.agg(F.sum("count")).first()[0] == 5 and n.where(F.col("bin") == P.MISSING_BIN).agg(F.sum("count")).first()[0] == 2
    constant = spark.range(50).select(F.lit(3.0).alias("x"), (F.col("id") % 2).alias("y"))
    assert {r["bin"] for r in P.numeric_by_class(constant, ["x"], "y", exact=True).collect()} == {"Bin_1_Low"}


def test_bivariate_routing(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("few"), F.col("id").alias("many"), (F.col("id") % 2).alias("y"))
    assert P.route_features(df, ["few", "many"]) == (["few"], ["many"])
    assert P.route_features(df, ["few", "many"], numeric=["few"]) == ([], ["few", "many"])


def test_top_buckets(spark):
    df = spark.range(100).select(F.concat(F.lit("v"), (F.col("id") % 8)).alias("c"), (F.col("id") % 2).alias("y"))
    out = P.categorical_by_class(df, ["c"], "y")
    assert out.select("bin").distinct().count() == 6
    assert out.where(F.col("bin") == P.OTHER_BIN).agg(F.sum("count")).first()[0] == 36


def test_psi_of_a_dataset_with_itself_is_zero(spark):
    df = spark.range(500).select((F.col("id") * 1.5).alias("x"), (F.col("id") % 4).cast("string").alias("c"), F.lit(2.0).alias("k"))
    assert all(abs(r["psi"]) < 1e-12 for r in D.psi(df, df, ["x", "c", "k"], exact=True).collect())


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_psi_does_not_depend_on_partitions(spark, parts):
    a = spark.range(900).select((F.col("id") % 97 * 1.0).alias("x"), (F.col("id") % 4).cast("string").alias("c")).repartition(parts)
    b = spark.range(700).select((F.col("id") % 89 * 1.3).alias("x"), (F.col("id") % 6).cast("string").alias("c")).repartition(parts)
    got = {r["feature"]: round(r["psi"], 9) for r in D.psi(a, b, ["x", "c"], exact=True).collect()}
    assert got["x"] > 0.05 and got["c"] > 1 and len(got) == 2
    test_psi_does_not_depend_on_partitions.seen = getattr(test_psi_does_not_depend_on_partitions, "seen", got)
    assert got == test_psi_does_not_depend_on_partitions.seen


def test_values_outside_the_reference_range_fall_in_the_open_bins(spark):
    a = spark.range(100).select(F.col("id").cast("double").alias("x"))
    b = spark.range(100).select((F.col("id") + 1000).cast("double").alias("x"))
    assert D.psi(a, b, ["x"], exact=True).first()["psi"] > 5


def test_correlations(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"), F.lit(1.0).alias("c"), (F.col("id") % 7).cast("double").alias("y"))
    m = R.correlation_matrix(df, ["a", "b", "c"])
    assert {(r["feature1"], r["feature2"]): r["correlation"] for r in m.collect()}[("a", "c")] is None
    assert R.collinear_pairs(m, ["a", "b", "c"]).first()["correlation"] == pytest.approx(-1.0)
    t = by_feature(R.target_correlation(df, ["a", "c"], "y"))
    assert t["c"]["correlation"] is None and t["c"]["strength"] == "undefined" and t["a"]["relationship_type"] in ("positive", "negative")


def test_text_target_is_indexed_for_correlation(spark):
    df = spark.range(60).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") < 40, "n").otherwise("y").alias("t"))
    assert R.target_correlation(df, ["a"], "t").first()["correlation"] > 0.7


def test_column_rules(spark):
    assert C.pick_columns(["a_x", "b_x", "a_y", "t"], include_prefix=["a_"], exclude_suffix=["_y"], target="t") == ["a_x"]
    assert C.raw_name("city_encoded") == "city" and C.raw_name("city") == "city"
    df = spark.createDataFrame([("2020-01-01", "x", "1700000000"), ("2020-01-02", "y", "1700000001"), (None, "z", None)], "my_date string, update_flag string, ts_time string")
    assert set(C.date_columns(df, df.columns)) == {"my_date", "ts_time"}
    nums = spark.createDataFrame([("$12 usd",), ("?",), ("-3.5",), ("NA",), ("1-2",), (None,)], "t string")
    assert [r["t"] for r in C.coerce_columns(nums, ["t"]).collect()] == [12.0, None, -3.5, None, None, None]
    with pytest.raises(ValueError):
        C.clean_numeric_target(spark.createDataFrame([("x",), (None,)], "t string"), "t")


def test_target_suggestion(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 0)], "id int, s string, y int")
    assert C.suggest_target(df) == "y" and C.suggest_target(df.drop("y")) == "s" and C.suggest_target(df, "regression") == "id"


def test_duplicates_and_missing_drift(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "dataset string, x int")
    assert {r["dataset"]: r["duplicate_rows"] for r in K.duplicate_rows(rows).collect()} == {"a": 1, "b": 0}


def test_cluster_insights_guard_zero_mean(spark):
    df = spark.createDataFrame([(0, 1.0), (1, -1.0)], "cluster int, x double")
    assert {r["pct_diff"] for r in CL.numeric_profiles(df, ["x"]).collect()} == {None}
    assert CL.distinctive_variables(df, ["x"]).first()["score"] == 0.0
