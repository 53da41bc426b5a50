"""Cluster profiles: what the rows of each cluster look like."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from featurelens.operators.profile import melt_text, numeric_univariate, with_top_bucket

OTHER = "Other"


def sizes(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Rows and percentage per cluster."""
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return counts.withColumn("percentage", F.col("size") / F.sum("size").over(W.partitionBy()) * 100)


def numeric_profiles(df: DataFrame, features: Sequence[str], cluster: str = "cluster", exact: bool = False) -> DataFrame:
    """Statistics per cluster and feature with the percent difference from the overall mean.

    The overall mean and deviation are merged from those of the clusters: no second scan.
    """
    per = numeric_univariate(df, features, [cluster], exact).withColumnRenamed(cluster, "cluster")
    every = W.partitionBy("feature")        # one row per cluster
    n = F.sum("count").over(every)
    per = per.withColumn("overall_mean", F.try_divide(F.sum(F.col("count") * F.col("mean")).over(every), n))
    spread = F.coalesce(F.col("stddev"), F.lit(0.0))
    square = (F.col("count") - 1) * spread * spread + F.col("count") * F.pow(F.col("mean") - F.col("overall_mean"), 2)
    per = per.withColumn("overall_std", F.sqrt(F.try_divide(F.sum(square).over(every), F.nullif(n - 1, F.lit(0)))))
    diff = F.try_divide(F.col("mean") - F.col("overall_mean"), F.col("overall_mean")) * 100
    return per.select("cluster", "feature", "count", "mean", "stddev", "median", "min", "max", "overall_mean", "overall_std", diff.alias("pct_diff"))


def categorical_profiles(df: DataFrame, features: Sequence[str], cluster: str = "cluster", top: int = 3) -> DataFrame:
    """Counts and shares per cluster for the overall top categories and the rest; missing rows count as rest."""
    long = melt_text(df.withColumn("_c", F.col(cluster)), features, ["_c"])
    counts = long.groupBy(F.col("_c").alias("cluster"), "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    tagged = with_top_bucket(counts, ["feature"], "n", top, OTHER, OTHER)
    out = tagged.groupBy("cluster", "feature", F.col("bin").alias("category")).agg(F.sum("n").alias("count"))
    return out.withColumn("percentage", F.col("count") / F.sum("count").over(W.partitionBy("cluster", "feature")) * 100)


def dominant_categories(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Most frequent category per cluster and feature with its share of the non-missing rows."""
    long = melt_text(df.withColumn("_c", F.col(cluster)), features, ["_c"]).where(F.col("value").isNotNull())
    counts = long.groupBy(F.col("_c").alias("cluster"), "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    # largest count, smallest value on ties
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "value"))
    out = counts.groupBy("cluster", "feature").agg(best.alias("_b"), F.sum("n").alias("_n"))
    share = F.col("_b.n") / F.col("_n") * 100
    return out.select("cluster", "feature", F.col("_b.value").alias("dominant_category"), share.alias("dominant_percentage"))


def distinctive_variables(df: DataFrame, features: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """C4: population std of the cluster means over their mean; zero mean gives 0."""
    means = numeric_univariate(df, features, [cluster]).groupBy("feature").agg(
        F.stddev_pop("mean").alias("_s"), F.avg("mean").alias("_m"), F.count("mean").alias("clusters")).where(F.col("clusters") > 1)
    return means.select("feature", "clusters", F.when(F.col("_m") != 0, F.col("_s") / F.col("_m")).otherwise(F.lit(0.0)).alias("score"))


def insights(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cluster: str = "cluster",
             difference: float = 20.0, share: float = 70.0) -> DataFrame:
    """Size line per cluster, means far from the overall mean, dominant categories."""
    s = sizes(df, cluster).select("cluster", F.lit("").alias("feature"), F.lit("size").alias("kind"), F.col("percentage").alias("value"),
                                  F.format_string("Size: %d samples (%.1f%% of data)", F.col("size"), F.col("percentage")).alias("insight"))
    parts = [s]
    if numeric:
        n = numeric_profiles(df, numeric, cluster).where(F.abs("pct_diff") > difference)
        side = F.when(F.col("pct_diff") > 0, "higher").otherwise("lower")
        parts.append(n.select("cluster", "feature", F.lit("numeric").alias("kind"), F.col("pct_diff").alias("value"),
                              F.format_string("%s: %.0f%% %s than average", F.col("feature"), F.abs("pct_diff"), side).alias("insight")))
    if categorical:
        c = dominant_categories(df, categorical, cluster).where(F.col("dominant_percentage") > share)
        parts.append(c.select("cluster", "feature", F.lit("categorical").alias("kind"), F.col("dominant_percentage").alias("value"),
                              F.format_string("%s: Mostly %s (%.0f%%)", F.col("feature"), F.col("dominant_category"), F.col("dominant_percentage")).alias("insight")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def profile_clusters(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], cluster: str = "prediction", exact: bool = False) -> dict[str, DataFrame]:
    """The profile tables of a scored table; original columns are still beside the label."""
    out = {"sizes": sizes(df, cluster), "insights": insights(df, numeric, categorical, cluster)}
    if numeric:
        out["numeric"] = numeric_profiles(df, numeric, cluster, exact)
        out["distinctive"] = distinctive_variables(df, numeric, cluster)
    if categorical:
        out["categorical"] = categorical_profiles(df, categorical, cluster)
        out["dominant"] = dominant_categories(df, categorical, cluster)
    return out
