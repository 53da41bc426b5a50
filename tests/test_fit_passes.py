"""A fit reads its table, and finds the part of each row, a fixed few times."""

from pyspark.sql import functions as F

from featurelens.operators import regression_metrics as RM
from featurelens.plans import pipeline as PL


def test_a_fit_finds_the_parts_of_its_rows_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def named(i: int) -> str:
        seen.add(1)
        return f"k{i}"

    df = spark.range(600).select(F.udf(named, "string")("id").alias("key"), (F.col("id") % 7).cast("double").alias("a"),
                                 (F.col("id") % 5).cast("double").alias("b"), (F.col("id") % 7 * 3 + F.col("id") % 5).cast("double").alias("label"))
    result = PL.fit_regressor(df, "label", "key", PL.FitConfig(models=("linear_regression", "decision_tree")))
    sizes = {r["dataset"] for r in result.metrics.collect()}
    assert sizes == {"train", "valid", "test"}
    # once for the column facts of the train part, once for the stored rows
    assert 600 <= seen.value <= 2 * 600


def test_regression_metrics_come_from_one_aggregation(spark):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("dataset"), F.col("id").cast("double").alias("y"),
                                 (F.col("id") * 0.9 + F.col("id") % 4).alias("prediction"))
    for exact in (False, True):
        found = {(r["dataset"], r["metric"]): r["value"] for r in RM.validate_regression(df, "y", exact=exact).collect()}
        parts = [RM.basic_metrics(df, "y", by=["dataset"]), RM.percentage_metrics(df, "y", by=["dataset"]), RM.extended_metrics(df, "y", by=["dataset"], exact=exact)]
        rows = {(r["dataset"], m): r[m] for p in parts for r in p.collect() for m in RM.METRICS if m in p.columns}
        assert found.keys() == rows.keys() and all(abs(found[k] - rows[k]) < 1e-9 * max(1, abs(rows[k])) for k in rows)
