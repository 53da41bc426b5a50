"""Comparison of profiled datasets. Input frames have one row per (dataset, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from featurelens.functions.expressions import field_type, is_floating
from featurelens.operators.joins import salted_join
from featurelens.operators.shared import join_groups

STATISTICS = ["count", "missing_percentage", "unique_count", "mean", "stddev", "min", "max"]


def feature_overlap(profile: DataFrame) -> DataFrame:
    """In how many datasets a feature occurs, which ones, common or not."""
    n = profile.select("dataset").distinct().agg(F.count(F.lit(1)).alias("_all"))
    per = profile.groupBy("feature").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))
    return per.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").select(
        "feature", F.array_join("datasets", ",").alias("datasets"), F.size("datasets").alias("dataset_count"),
        (F.size("datasets") == F.col("_all")).alias("is_common"))


def quality_comparison(profile: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Missing figures per dataset and, given the tagged rows, their duplicates."""
    out = profile.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.col("missing_percentage") > 0).alias("features_with_missing"),
        F.avg("missing_percentage").alias("avg_missing_percentage"),
        F.sum("missing_count").alias("total_missing_values"))
    return out if rows is None else out.join(duplicate_rows(rows), "dataset", "left")


def _hashable(df: DataFrame, name: str) -> Column:
    """A column in a form whose hash is the same for equal values."""
    c, kind = F.col(f"`{name}`"), field_type(df, name)
    if is_floating(kind):
        return F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)       # both zeros
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def duplicate_rows(rows: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, per dataset; nulls are equal, as are NaNs.

    Fingerprints of 128 bits are counted first; whole rows are compared only where a fingerprint repeats.
    """
    # columns by place: their own names cannot clash with the ones made here
    names = [f"c{i}" for i in range(len(rows.columns))]
    dataset = names[rows.columns.index("dataset")]
    rows = rows.toDF(*names)
    parts = [_hashable(rows, c) for c in names]
    # a null leaves a hash as it is: its place is hashed too
    gaps = F.concat_ws("", *[F.col(c).isNull().cast("int").cast("string") for c in names])
    marked = rows.withColumn("h1", F.xxhash64(*parts)).withColumn("h2", F.xxhash64(F.lit("second"), gaps, *parts[::-1]))
    counts = marked.groupBy(dataset, "h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    again = counts.where(F.col("copies") > 1).groupBy("h1", "h2").agg(F.lit(True).alias("again"))
    whole = salted_join(marked, again, ["h1", "h2"]).groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    found = whole.groupBy(dataset).agg((F.sum("copies") - F.count(F.lit(1))).alias("found"))
    every = join_groups(counts.select(dataset).distinct(), found, [dataset], "left")
    return every.select(F.col(dataset).alias("dataset"), F.coalesce("found", F.lit(0).cast("bigint")).alias("duplicate_rows"))


def statistics_side_by_side(profile: DataFrame, datasets: Sequence[str], stats: Sequence[str] = STATISTICS) -> DataFrame:
    """One row per common feature, one column per dataset and statistic."""
    wide = profile.groupBy("feature").agg(
        F.count_distinct("dataset").alias("_in"),
        *[F.max(F.when(F.col("dataset") == d, F.col(s))).alias(f"{d}_{s}") for d in datasets for s in stats])
    return wide.where(F.col("_in") == len(datasets)).drop("_in")


def top_correlations(corr: DataFrame, n: int = 10) -> DataFrame:
    """A29 part 1: strongest target correlations per dataset."""
    rank = W.partitionBy("dataset").orderBy(F.desc_nulls_last("abs_correlation"), "feature")
    return corr.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def correlation_differences(corr: DataFrame, threshold: float = 0.1) -> DataFrame:
    """A29 part 2: features whose target correlation ranges over ``threshold``."""
    out = corr.groupBy("feature").agg(
        F.count("correlation").alias("datasets"), F.min("correlation").alias("min_correlation"),
        F.max("correlation").alias("max_correlation"),
        (F.max("correlation") - F.min("correlation")).alias("max_difference"))
    return out.where((F.col("datasets") >= 2) & (F.col("max_difference") > threshold))


def missing_drift(profile: DataFrame, points: float = 5.0) -> DataFrame:
    """Features whose missing percentage differs by more than ``points``."""
    out = profile.groupBy("feature").agg(
        F.count(F.lit(1)).alias("datasets"), F.min("missing_percentage").alias("min_missing"),
        F.max("missing_percentage").alias("max_missing"),
        (F.max("missing_percentage") - F.min("missing_percentage")).alias("difference"))
    return out.where((F.col("datasets") > 1) & (F.col("difference") > points))


def variable_ranking(profile: DataFrame, n: int = 5) -> DataFrame:
    """Widest numeric features (stddev, with CV) and largest categoricals per dataset."""
    numeric = profile.where(F.col("feature_type") != "categorical").where(F.col("stddev").isNotNull())
    cats = profile.where(F.col("feature_type") == "categorical")
    cv = F.when(F.col("mean") != 0, F.col("stddev") / F.abs("mean")).otherwise(F.lit(0.0))
    both = numeric.select("dataset", "feature", F.lit("numeric").alias("kind"), F.col("stddev").alias("measure"), cv.alias("cv")).unionByName(
        cats.select("dataset", "feature", F.lit("categorical").alias("kind"), F.col("unique_count").cast("double").alias("measure"),
                    F.lit(None).cast("double").alias("cv")))
    rank = W.partitionBy("dataset", "kind").orderBy(F.desc("measure"), "feature")
    return both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def comparison_report(profile: DataFrame, corr: DataFrame, rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The comparison tables together."""
    datasets = [r["dataset"] for r in profile.select("dataset").distinct().orderBy("dataset").collect()]
    return {
        "features": feature_overlap(profile),
        "quality": quality_comparison(profile, rows),
        "statistics": statistics_side_by_side(profile, datasets),
        "top_correlations": top_correlations(corr),
        "correlation_differences": correlation_differences(corr),
        "missing_drift": missing_drift(profile),
        "variables": variable_ranking(profile),
    }


def report_long(report: dict[str, DataFrame]) -> DataFrame:
    """The report as ``section, item, measure, value`` rows, numbers only."""
    out = None
    for section, table in report.items():
        ids = [c for c in ("dataset", "feature", "kind") if c in table.columns]
        numbers = [f.name for f in table.schema if f.dataType.typeName() in ("double", "long", "integer") and f.name not in ids]
        item = F.concat_ws("/", *ids)
        part = table.select(item.alias("item"), *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(
            ["item"], numbers, "measure", "value").select(F.lit(section).alias("section"), "item", "measure", "value")
        out = part if out is None else out.unionByName(part)
    return out
