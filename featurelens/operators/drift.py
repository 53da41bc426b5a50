"""Population stability between datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from featurelens.functions.expressions import as_double, bucket_tree, field_type, is_numeric
from featurelens.operators.joins import align_distributions
from featurelens.operators.profile import MISSING_BIN, melt_numeric, melt_text, tag_datasets
from featurelens.operators.quantiles import exact_quantiles
from featurelens.operators.shared import join_groups, pin_small

SMOOTHING = 0.0001
# PSI limits and the status and shift names below each of them.
STATUSES = [(0.1, "stable", "none"), (0.2, "moderately_stable", "minimal"), (0.25, "unstable", "moderate")]
WORST = ("very_unstable", "significant")


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int = 10, exact: bool = False,
                   by: Sequence[str] = ()) -> DataFrame:
    """Inner bin edges per feature (distinct, ascending); outer bins are open.

    Numeric bins are ``(-inf, e1), [e1, e2), ..., [ek, +inf)``.
    """
    probs = [i / bins for i in range(1, bins)]
    long = melt_numeric(df, features, by)
    keys = [*by, "feature"]
    if exact:
        q = exact_quantiles(long, keys, "value", probs)
        edges = q.groupBy(*keys).agg(F.array_sort(F.collect_set("q")).alias("edges"))
    else:
        edges = long.groupBy(*keys).agg(
            F.array_sort(F.array_distinct(F.percentile_approx("value", probs, 10_000))).alias("edges"))
    return pin_small(edges)[0]


def bin_shares(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], edges: DataFrame | None,
               by: Sequence[str] = ()) -> DataFrame:
    """Share of rows per ``(feature, bin)``; missing values have their own bin."""
    parts = []
    keys = [*by, "feature"]
    if numeric:
        # the edges are a few numbers for each feature: bins come from the wide row, without a join
        cuts = {r["feature"]: [e for e in r["edges"] or [] if e is not None] for r in edges.collect()}

        def binned(f: str) -> Column:
            v = as_double(f, field_type(df, f))
            name = F.when(v.isNull(), MISSING_BIN).otherwise(F.format_string("bin_%02d", bucket_tree(v, cuts.get(f, []))))
            return F.struct(F.lit(f).alias("feature"), name.alias("bin"))

        long = df.select(*by, F.inline(F.array(*[binned(f) for f in numeric])))
        parts.append(long.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    if categorical:
        long = melt_text(df, categorical, by).withColumn("bin", F.coalesce("value", F.lit(MISSING_BIN)))
        parts.append(long.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")))
    counts = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # rows per group do not depend on the feature: no window over the values
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")) if by else df.agg(F.count(F.lit(1)).alias("_total"))
    totals, rows = pin_small(totals)
    if by:
        counts = join_groups(counts, totals, list(by))
    else:
        counts = counts.withColumn("_total", F.lit(rows[0]["_total"]))
    return counts.withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def psi_from_shares(aligned: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Sum of (actual - expected) * ln(actual / expected), zero share 0.0001."""
    e = F.when(F.col("expected") == 0, SMOOTHING).otherwise(F.col("expected"))
    a = F.when(F.col("actual") == 0, SMOOTHING).otherwise(F.col("actual"))
    return aligned.groupBy(*keys).agg(F.sum((a - e) * F.ln(a / e)).alias("psi"))


def split_kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    numeric = [f for f in features if is_numeric(field_type(df, f))]
    return numeric, [f for f in features if f not in numeric]


def psi(expected: DataFrame, actual: DataFrame, features: Sequence[str], bins: int = 10, exact: bool = False) -> DataFrame:
    """A17 + A18: PSI of every feature between two datasets; edges from ``expected``."""
    numeric, categorical = split_kinds(expected, features)
    edges = quantile_edges(expected, numeric, bins, exact) if numeric else None
    e = bin_shares(expected, numeric, categorical, edges)
    a = bin_shares(actual, numeric, categorical, edges)
    return psi_from_shares(align_distributions(e, a, ["feature", "bin"]))


def psi_pairs(datasets: dict[str, DataFrame], features: Sequence[str], bins: int = 10, exact: bool = False) -> DataFrame:
    """A19 part 1: PSI of every feature for every pair ``first_vs_second``.

    The edges of a first dataset are fitted once and the dataset and all later
    ones are binned with them in one job.
    """
    names = list(datasets)
    if len(names) < 2:
        raise ValueError("at least two datasets are needed")
    tagged = tag_datasets({n: d.select(*features) for n, d in datasets.items()})
    numeric, categorical = split_kinds(tagged, features)
    out = None
    for i, first in enumerate(names[:-1]):
        edges = quantile_edges(datasets[first], numeric, bins, exact) if numeric else None
        shares = bin_shares(tagged.where(F.col("dataset").isin(names[i:])), numeric, categorical, edges, ["dataset"])
        e = shares.where(F.col("dataset") == first).select("feature", "bin", F.col("share").alias("expected"))
        # the expected side once per later dataset
        later = F.explode(F.array(*[F.lit(n) for n in names[i + 1:]]))
        e = e.withColumn("dataset", later)
        a = shares.where(F.col("dataset") != first).select("dataset", "feature", "bin", F.col("share").alias("actual"))
        both = e.join(a, ["dataset", "feature", "bin"], "full_outer").fillna(0.0, ["expected", "actual"])
        part = psi_from_shares(both, ["feature", "dataset"]).select(
            "feature", "psi", F.concat(F.lit(first + "_vs_"), F.col("dataset")).alias("comparison"))
        out = part if out is None else out.unionByName(part)
    return out


def _status(value: Column, position: int) -> Column:
    out = F.lit(WORST[position])
    for row in reversed(STATUSES):
        out = F.when(value < row[0], row[1 + position]).otherwise(out)
    return out


def stability(pairs: DataFrame) -> DataFrame:
    """A19 part 2: highest PSI per feature with status and shift names."""
    out = pairs.groupBy("feature").agg(F.max("psi").alias("max_psi"))
    return out.withColumn("stability_status", _status(F.col("max_psi"), 0)).withColumn(
        "distribution_shift", _status(F.col("max_psi"), 1))


def stability_summary(pairs: DataFrame) -> DataFrame:
    """A19 part 3: averages and counts over the whole comparison."""
    feats = stability(pairs).agg(
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.col("stability_status") == "stable").alias("stable_features"),
        F.count_if(F.col("stability_status").isin("unstable", "very_unstable")).alias("unstable_features"))
    scores = pairs.agg(F.avg("psi").alias("average_psi"), F.max("psi").alias("maximum_psi"))
    # two one-row frames
    return scores.withColumn("_k", F.lit(1)).join(feats.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn(
        "overall_stability", F.when(F.col("average_psi") < 0.1, "stable").when(
            F.col("average_psi") < 0.2, "moderately_stable").otherwise("unstable"))
