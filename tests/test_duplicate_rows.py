"""Duplicate rows by fingerprints against a grouping of the whole rows."""

import pytest
from pyspark.sql import functions as F

import featurelens.operators.joins as J
from featurelens.operators.compare import duplicate_rows

SCHEMA = "dataset string, a string, b string, x double, _c int, n array<int>"


def expected(df):
    same = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return {r["dataset"]: r["d"] for r in same.groupBy("dataset").agg((F.sum("copies") - F.count(F.lit(1))).alias("d")).collect()}


@pytest.mark.parametrize("salt_over", [J.SALT_OVER_ROWS, 10])
def test_duplicates_equal_a_grouping_of_whole_rows(spark, monkeypatch, salt_over):
    monkeypatch.setattr(J.salted_join, "__defaults__", ("inner", None, salt_over))
    nan = float("nan")
    rows = [("t", "k", None, 1.0, 1, [1]), ("t", None, "k", 1.0, 1, [1]), ("t", "k", None, 1.0, 1, [1]),       # shifted null
            ("t", "z", "z", 0.0, 1, None), ("t", "z", "z", -0.0, 1, None), ("t", "n", "n", nan, None, []), ("t", "n", "n", nan, None, []),
            ("u", "k", None, 1.0, 1, [1]), ("u", "l", None, 1.0, 1, [1]), (None, "q", "q", None, None, None), (None, "q", "q", None, None, None),
            ("v", None, None, None, None, None)]
    rows += [("hot", "same", "same", 2.0, 2, [2])] * 60 + [("hot", f"r{i % 25}", "", 2.0, 2, [2]) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["dataset"]: r["duplicate_rows"] for r in duplicate_rows(df).collect()}
    assert got == expected(df) == {"t": 3, "u": 0, None: 1, "v": 0, "hot": 59 + 15}
    assert duplicate_rows(df.limit(0)).count() == 0


def test_a_shared_fingerprint_is_no_duplicate(spark, monkeypatch):
    # with one fingerprint for all, only the comparison of whole rows decides
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    df = spark.createDataFrame([("t", "a"), ("t", "b"), ("t", "a"), ("u", "a")], "dataset string, a string")
    assert {r["dataset"]: r["duplicate_rows"] for r in duplicate_rows(df).collect()} == {"t": 1, "u": 0}
