"""Merged states against the whole table."""

import math

import pytest
from pyspark.sql import functions as F

from featurelens.operators import states as ST
from featurelens.operators.drift import psi


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(6000).withColumn("u", F.pmod(F.xxhash64("id"), F.lit(100_000)) / 100_000)
    return df.select(
        "id", F.pmod("id", F.lit(7)).cast("string").alias("day"), F.when(F.pmod("id", F.lit(11)) != 0, 1e9 + F.col("u")).alias("large"),
        (F.sqrt(F.col("u")) + F.pmod("id", F.lit(7)) * 0.1).alias("moving"), F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("u") < 0.02, " ").otherwise(F.concat(F.lit("c"), F.floor(F.col("u") * F.col("u") * 9))).alias("city")).persist()


NUMERIC, CATEGORICAL = ["large", "moving", "nothing"], ["city"]


def test_stored_days_merge_to_the_whole(spark, rows, tmp_path):
    for day in range(7):
        ST.write_state(ST.take_state(rows.where(F.col("day") == day), NUMERIC, CATEGORICAL), str(tmp_path), f"day/{day}")
    ST.write_state(ST.take_state(rows.where("day = '3'"), NUMERIC, CATEGORICAL), str(tmp_path), "day/3")      # again: replaced
    stored = ST.read_states(spark, str(tmp_path))
    assert stored.columns.count() == 7 * 4 and ST.read_states(spark, str(tmp_path), ["day/2"]).columns.count() == 4
    got = {r["feature"]: r for r in ST.profile_of_state(ST.merge_states(stored)).collect()}
    for f in NUMERIC[:2]:
        want = rows.agg(F.count_if(F.col(f).isNull()).alias("m"), F.avg(f).alias("a"), F.stddev(f).alias("s"), F.min(f).alias("lo"), F.max(f).alias("hi"),
                        F.percentile(f, [0.25, 0.5, 0.75]).alias("q"), F.count_distinct(f).alias("d")).first()
        r = got[f]
        assert (r["total_rows"], r["missing_count"], r["min"], r["max"]) == (6000, want["m"], want["lo"], want["hi"])
        # values of 1e9 with a deviation under 1: sums of squares would lose it, means are rounded at 1e-7
        assert math.isclose(r["mean"], want["a"], rel_tol=1e-12) and math.isclose(r["stddev"], want["s"], rel_tol=1e-5)
        assert abs(r["unique_count"] - want["d"]) <= 0.03 * want["d"]
        for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75")):
            below = rows.where(F.col(f) <= r[name]).count() / rows.where(F.col(f).isNotNull()).count()
            assert abs(below - p) < 0.015
    assert got["nothing"]["mean"] is None and got["nothing"]["median"] is None and got["nothing"]["unique_count"] == 0
    assert got["city"]["missing_count"] == rows.where("city = ' '").count() and got["city"]["mean"] is None
    counts = {r["value"]: r["n"] for r in ST.merge_states(stored).values.collect()}
    assert counts == {(None if r["city"] == " " else r["city"]): r["count"] for r in rows.groupBy("city").count().collect()}


def test_psi_of_two_states_is_near_that_of_the_rows(spark, rows, tmp_path):
    early, late = rows.where("day < '3'"), rows.where("day >= '3'")
    features = ["large", "moving", "city"]
    got = {r["feature"]: r["psi"] for r in ST.psi_of_states(*[
        ST.merge_states(ST.take_state(d, ["large", "moving", "nothing"], ["city"], by=["day"])) for d in (early, late)]).collect()}
    want = {r["feature"]: r["psi"] for r in psi(early, late, features).collect()}
    assert math.isclose(got["city"], want["city"], abs_tol=1e-12)
    assert abs(got["moving"] - want["moving"]) < 0.05 * want["moving"] and want["moving"] > 0.2
    assert abs(got["large"] - want["large"]) < 0.02 and got["nothing"] == 0.0
    ST.write_state(ST.take_state(early, ["moving"]), str(tmp_path), "early")
    same = ST.read_states(spark, str(tmp_path))
    assert {r["feature"]: r["psi"] for r in ST.psi_of_states(same, same).collect()} == {"moving": 0.0}


def test_empty_batches(rows):
    empty = ST.take_state(rows.limit(0), ["moving"], ["city"])
    both = ST.ProfileState(empty.columns.unionByName(ST.take_state(rows, ["moving"], ["city"]).columns), ST.take_state(rows, ["moving"], ["city"]).values)
    got = {r["feature"]: r for r in ST.profile_of_state(ST.merge_states(both)).collect()}
    assert got["moving"]["total_rows"] == 6000 and got["moving"]["stddev"] is not None
    alone = {r["feature"]: r for r in ST.profile_of_state(empty).collect()}
    assert alone["moving"]["total_rows"] == 0 and alone["moving"]["missing_fraction"] is None
    assert ST.psi_of_states(empty, empty).count() == 0
    assert ST.take_state(rows.limit(0), ["moving"], by=["day"]).columns.count() == 0
    with pytest.raises(ValueError):
        ST.take_state(rows)
