"""Profiling: missing values, cardinality, univariate and target relations.

Scalar statistics of all columns come from one wide aggregation (no shuffle
beyond one row per task and group); value counts use one long frame and one
shuffle for all columns together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from featurelens.functions.expressions import (
    approx_distinct, as_double, field_type, is_missing, is_numeric, is_string, null_if_missing,
)
from featurelens.operators.quantiles import exact_quantiles, quantile_columns
from featurelens.operators.shared import join_groups, pin_small

MISSING_BIN = "(missing)"
OTHER_BIN = "OTHER_CATEGORIES"
# Bin names of the four quartile bins and the overflow bin.
BIN_NAMES = ["Bin_1_Low", "Bin_2_Lower_Mid", "Bin_3_Upper_Mid", "Bin_4_High", "Bin_5_Very_High"]
# Points per quality grade and the score each overall grade needs.
GRADE_POINTS = {"A": 95.0, "B": 85.0, "C": 75.0, "D": 65.0, "F": 50.0}
GRADE_FLOORS = [("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0)]
# Estimated bytes per value by type, and size classes in MB.
TYPE_BYTES = {"double": 8.0, "long": 8.0, "integer": 4.0, "boolean": 1.0, "binary": 64.0}
OTHER_TYPE_BYTES = 16.0
SIZE_CLASSES_MB = [("small", 100.0), ("medium", 1000.0), ("large", 10000.0)]

QUARTILES = {0.25: "q25", 0.5: "median", 0.75: "q75"}


def check_flat(df: DataFrame, features: Sequence[str]) -> None:
    nested = [f for f in features if isinstance(field_type(df, f), (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise TypeError(f"nested columns cannot be profiled: {nested}")


def _per_feature(df: DataFrame, features: Sequence[str], by: Sequence[str], make) -> DataFrame:
    """One wide aggregation; ``make(name, dtype)`` gives the aggregates of a column."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), *make(f, field_type(df, f))) for f in features])
    return df.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.inline("_rows"))


def _named(keep: Sequence[str]) -> list[Column]:
    """Kept columns under fresh attributes, so that two uses of a long frame can share a shuffle."""
    return [F.col(k).alias(k) for k in keep]


def melt_numeric(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(*keep, feature, value double)``; missing values are null."""
    wide = df.select(*keep, *[as_double(f, field_type(df, f)).alias(f) for f in features])
    return wide.unpivot(_named(keep), list(features), "feature", "value")


def melt_text(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``(*keep, feature, value string)``; missing values are null."""
    wide = df.select(*keep, *[null_if_missing(f, field_type(df, f)).cast("string").alias(f) for f in features])
    return wide.unpivot(_named(keep), list(features), "feature", "value")


def missing_counts(df: DataFrame, features: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """A1: ``feature, missing_count, total_rows, missing_fraction``."""
    features = list(features or [c for c in df.columns if c not in by])
    out = _per_feature(df, features, by, lambda f, t: [
        F.count_if(is_missing(f, t)).alias("missing_count"), F.count(F.lit(1)).alias("total_rows")])
    return out.withColumn("missing_fraction", F.try_divide(F.col("missing_count"), F.col("total_rows")))


def categorical_cardinality(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A2: approximate distinct count, missing count and percentage."""
    out = _per_feature(df, features, by, lambda f, t: [
        approx_distinct(null_if_missing(f, t), t).alias("unique_count"),
        F.count_if(is_missing(f, t)).alias("missing_count"),
        F.count(F.lit(1)).alias("total_count")])
    return out.withColumn("missing_percentage", F.try_divide(F.col("missing_count"), F.col("total_count")) * 100)


def value_counts(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, feature, value, count)`` of the non-missing values, all columns in one shuffle."""
    long = melt_text(df, features, by).where(F.col("value").isNotNull())
    return long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("count"))


def exact_cardinality(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A3: exact distinct count, missing count and percentage."""
    distinct = value_counts(df, features, by).groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("unique_count"))
    base = missing_counts(df, features, by)
    joined = join_groups(base, distinct, [*by, "feature"], "left")
    return joined.select(
        *by, "feature", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "missing_count",
        F.col("total_rows").alias("total_count"), (F.col("missing_fraction") * 100).alias("missing_percentage"))


def _numeric_stats(f: str, t: T.DataType, exact: bool) -> list[Column]:
    """Moments and range (nulls for a column that is not numeric), with quartiles from a sketch unless exact."""
    if not (is_numeric(t) or isinstance(t, T.BooleanType)):
        names = ["mean", "stddev", "min", "max", *([] if exact else QUARTILES.values())]
        return [F.lit(None).cast("double").alias(n) for n in names]
    v = as_double(f, t)
    cols = [F.avg(v).alias("mean"), F.stddev(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max")]
    if exact:
        return cols
    q = F.percentile_approx(v, list(QUARTILES), 10_000)
    return cols + [q.getItem(i).alias(n) for i, n in enumerate(QUARTILES.values())]


def _with_exact_quartiles(df: DataFrame, features: Sequence[str], by: Sequence[str], stats: DataFrame, rows: list, distinct: str) -> DataFrame:
    keys = [*by, "feature"]
    # one row per feature and group: its counts also steer the quantiles
    sizes = {tuple(r[k] for k in keys): (r["count"], r[distinct]) for r in rows if r["feature"] in features}
    q = exact_quantiles(melt_numeric(df, features, by), keys, "value", list(QUARTILES), sizes=sizes)
    return join_groups(stats, quantile_columns(q, keys, QUARTILES), keys, "left")


def numeric_univariate(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """A4: count, mean, stddev, min, max and quartiles of numeric columns."""
    check_flat(df, features)

    def stats(f: str, t: T.DataType) -> list[Column]:
        v = as_double(f, t)
        more = [F.approx_count_distinct(v).alias("_distinct")] if exact else []
        return [F.count(v).alias("count"), *_numeric_stats(f, t, exact), *more]

    out = _per_feature(df, features, by, stats)
    if not exact:
        return out
    out, rows = pin_small(out)
    return _with_exact_quartiles(df, features, by, out.drop("_distinct"), rows, "_distinct")


def top_values(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """The ``n`` most frequent values per column, ties by value."""
    rank = W.partitionBy(*by, "feature").orderBy(F.desc("count"), "value")
    return value_counts(df, features, by).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def categorical_univariate(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), n: int = 10) -> DataFrame:
    """A5: non-missing count of the column beside its top values."""
    totals = _per_feature(df, features, by, lambda f, t: [F.count(null_if_missing(f, t)).alias("non_null_count")])
    return join_groups(top_values(df, features, by, n), totals, [*by, "feature"])


def univariate_profile(
    df: DataFrame, features: Sequence[str] | None = None, by: Sequence[str] = (), exact: bool = False,
) -> DataFrame:
    """A4-A7 in one table: one row per feature (and group) with kind, warnings and grade."""
    features = list(features or [c for c in df.columns if c not in by])
    check_flat(df, features)
    numeric = [f for f in features if is_numeric(field_type(df, f))]
    types = F.create_map(*[F.lit(x) for f in features for x in (f, field_type(df, f).typeName())])

    def stats(f: str, t: T.DataType) -> list[Column]:
        value = null_if_missing(f, t)
        return [F.count(F.lit(1)).alias("total_rows"), F.count_if(is_missing(f, t)).alias("missing_count"), F.count(value).alias("count"),
                approx_distinct(value, t).alias("unique_count"), *_numeric_stats(f, t, exact)]

    # everything but exact distinct counts and exact quartiles comes from one scan
    out = _per_feature(df, features, by, stats)
    if exact:
        keys = [*by, "feature"]
        out, rows = pin_small(out)
        distinct = value_counts(df, features, by).groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_count"))
        out = out.drop("unique_count")
        out = join_groups(out, distinct, keys, "left").fillna(0, ["unique_count"])
        if numeric:
            out = _with_exact_quartiles(df, numeric, by, out, rows, "unique_count")
        else:
            out = out.withColumns({n: F.lit(None).cast("double") for n in QUARTILES.values()})
    out = (out.withColumn("data_type", F.element_at(types, F.col("feature")))
              .withColumn("missing_percentage", F.try_divide(F.col("missing_count"), F.col("total_rows")) * 100))
    return with_quality(with_feature_kind(out))


def with_feature_kind(profile: DataFrame) -> DataFrame:
    """Discrete (numeric, 1 to 10 distinct), continuous or categorical."""
    numeric = F.col("data_type").rlike("^(integer|long|float|double|decimal|short|byte)")
    few = (F.col("unique_count") > 0) & (F.col("unique_count") <= 10)
    return profile.withColumn(
        "feature_type", F.when(numeric & few, "discrete").when(numeric, "continuous").otherwise("categorical"))


def with_quality(profile: DataFrame) -> DataFrame:
    """``warnings`` (array of ``name:severity``) and ``grade`` per feature."""
    miss, uniq, total = F.col("missing_percentage"), F.col("unique_count"), F.col("total_rows")
    ratio = F.try_divide(uniq, total)
    warnings = F.array_compact(F.array(
        F.when(miss > 50, "high_missing_values:high").when(miss > 20, "high_missing_values:moderate"),
        F.when(uniq == 1, "constant_feature:critical"),
        F.when((ratio > 0.95) & (uniq > 100), "high_cardinality:moderate"),
        F.when(F.col("stddev") < 0.01, "low_variance:moderate")))
    severe = lambda s: F.exists("warnings", lambda w: w.endswith(s))
    return profile.withColumn("warnings", warnings).withColumn(
        "grade", F.when(F.size("warnings") == 0, "A").when(severe(":critical"), "F").when(severe(":high"), "C").otherwise("B"))


def quality_score(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the grade points over the features and the overall grade."""
    points = F.create_map(*[F.lit(x) for kv in GRADE_POINTS.items() for x in kv])
    out = profile.groupBy(*by).agg(
        F.count(F.lit(1)).alias("features"), F.avg(F.element_at(points, F.col("grade"))).alias("overall_score"))
    grade = F.lit("F")
    for name, floor in reversed(GRADE_FLOORS):
        grade = F.when(F.col("overall_score") >= floor, name).otherwise(grade)
    return out.withColumn("overall_grade", grade)


def class_distribution(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share per class with minority, majority and class number."""
    counts = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("count"))
    every = W.partitionBy(*by)
    return counts.select(
        *by, target, "count",
        (F.col("count") / F.sum("count").over(every)).alias("share"),
        F.min_by(target, F.struct("count", target)).over(every).alias("minority_class"),
        F.max_by(target, F.struct("count", target)).over(every).alias("majority_class"),
        F.min("count").over(every).alias("minority_count"),
        F.max("count").over(every).alias("majority_count"),
        F.count(F.lit(1)).over(every).alias("num_classes"))


def detect_imbalance(distribution: DataFrame, threshold: float = 0.05) -> DataFrame:
    """A10: is any class share under ``threshold``?"""
    return distribution.agg(
        F.bool_or(F.col("share") < threshold).alias("is_imbalanced"),
        F.count_if(F.col("share") < threshold).alias("imbalanced_classes"),
        F.min("share").alias("minority_share"))


def detect_problem_type(df: DataFrame, target: str) -> DataFrame:
    """Binary or multiclass by the number of target values."""
    text = is_string(field_type(df, target))
    out = df.groupBy(target).agg(F.lit(1).alias("_one")).where(F.col(target).isNotNull()).agg(
        F.count(F.lit(1)).alias("num_classes"))
    return out.select(
        F.lit(target).alias("target"), "num_classes",
        F.when(F.col("num_classes") > 2, "multiclass").otherwise("binary").alias("problem_type"),
        F.lit(text).alias("needs_encoding"))


def with_top_bucket(counts: DataFrame, keys: Sequence[str], weight: str, n: int, other: str = OTHER_BIN,
                    missing: str = MISSING_BIN) -> DataFrame:
    """``bin`` = value, but ``other`` for values outside the ``n`` heaviest of a feature.

    Ranking and tagging read the same counts. No filter sits between them and
    the join is null-safe, so Spark reuses one shuffle instead of scanning twice.
    """
    keys = list(keys)
    weighed = counts.groupBy(*keys, "value").agg(F.sum(weight).alias("_w"))
    rank = W.partitionBy(*keys).orderBy(F.col("value").isNull(), F.desc("_w"), "value")
    top = weighed.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= n)
    names = {k: f"_top_{k}" for k in [*keys, "value"]}
    top = top.select(*[F.col(k).alias(v) for k, v in names.items()])
    same = F.lit(True)
    for k, v in names.items():
        same = same & F.col(k).eqNullSafe(F.col(v))
    # at most n rows per feature: the hint is safe whatever the table size
    joined = counts.join(top, same, "left")
    inside = F.col(names["value"]).isNotNull()
    bin_ = F.when(F.col("value").isNull(), missing).when(inside, F.col("value")).otherwise(other)
    return joined.withColumn("bin", bin_).drop(*names.values())


def categorical_by_class(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), n: int = 5) -> DataFrame:
    """Class counts and percentages within the top categories, the rest and the missing."""
    keys = [*by, "feature"]
    counts = (melt_text(df.withColumn("_t", F.col(target).cast("string")), features, [*by, "_t"])
              .groupBy(*keys, "value", F.col("_t").alias("target_value")).agg(F.count(F.lit(1)).alias("_c")))
    out = with_top_bucket(counts, keys, "_c", n).groupBy(*keys, "bin", "target_value").agg(F.sum("_c").alias("count"))
    total = F.sum("count").over(W.partitionBy(*keys, "bin"))
    return out.select(*keys, "bin", "target_value", "count", (F.col("count") / total * 100).alias("percentage"))


def categorical_by_value(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), n: int = 5) -> DataFrame:
    """Count, mean and stddev of a numeric target within the top categories, the rest and the missing."""
    keys = [*by, "feature"]
    y = as_double(target, field_type(df, target))
    # moments per category first: the bucket step then merges a few rows per category
    long = melt_text(df.withColumn("_y", y), features, [*by, "_y"])
    moments = long.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("_y").alias("_n"), F.avg("_y").alias("_m"),
        (F.var_pop("_y") * F.count("_y")).alias("_ss"))
    # the count of a category is the number of its rows, as in the class table
    tagged = with_top_bucket(moments, keys, "_rows", n)
    # parallel merge of moments: total variation = within + between
    grouped = tagged.groupBy(*keys, "bin").agg(
        F.sum("_n").alias("count"), F.try_divide(F.sum(F.col("_n") * F.col("_m")), F.sum("_n")).alias("target_mean"),
        F.sum("_ss").alias("_w"), (F.sum(F.col("_n") * F.col("_m") * F.col("_m"))).alias("_q"))
    between = F.greatest(F.col("_q") - F.col("count") * F.col("target_mean") * F.col("target_mean"), F.lit(0.0))
    std = F.when(F.col("count") > 1, F.sqrt((F.col("_w") + between) / (F.col("count") - 1)))
    return grouped.select(*keys, "bin", "count", "target_mean", std.alias("target_std"))


def quartile_edges(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Edges min, q25, mid, q75, max of the numeric bins, pinned (one row per feature)."""
    stats = numeric_univariate(df, features, by, exact).where(F.col("count") > 0)
    edges = stats.select(*by, "feature", "min", "q25", ((F.col("q25") + F.col("q75")) / 2).alias("mid"), "q75", "max")
    return pin_small(edges)[0]


def with_quartile_bin(long: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    v = F.col("value")
    name = F.when(v.isNull(), MISSING_BIN)
    for edge, label in zip(["q25", "mid", "q75", "max"], BIN_NAMES):
        name = name.when(v <= F.col(edge), label)
    # a feature without a value has no edges; all its rows are missing
    return join_groups(long, edges, [*by, "feature"], "left").withColumn("bin", name.otherwise(BIN_NAMES[-1])).drop(
        "min", "q25", "mid", "q75", "max")


def numeric_by_class(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), exact: bool = False,
                     edges: DataFrame | None = None) -> DataFrame:
    """Class counts and percentages per quartile bin."""
    edges = edges if edges is not None else quartile_edges(df, features, by, exact)
    long = melt_numeric(df.withColumn("_t", F.col(target).cast("string")), features, [*by, "_t"])
    keys = [*by, "feature"]
    out = with_quartile_bin(long, edges, by).groupBy(*keys, "bin", F.col("_t").alias("target_value")).agg(
        F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(*keys, "bin"))
    return out.select(*keys, "bin", "target_value", "count", (F.col("count") / total * 100).alias("percentage"))


def numeric_by_value(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), exact: bool = False,
                     edges: DataFrame | None = None) -> DataFrame:
    """Count, mean and stddev of a numeric target per quartile bin."""
    edges = edges if edges is not None else quartile_edges(df, features, by, exact)
    y = as_double(target, field_type(df, target))
    long = melt_numeric(df.withColumn("_y", y), features, [*by, "_y"])
    return with_quartile_bin(long, edges, by).groupBy(*by, "feature", "bin").agg(
        F.count("_y").alias("count"), F.avg("_y").alias("target_mean"), F.stddev("_y").alias("target_std"))


def route_features(df: DataFrame, features: Sequence[str], categorical: Sequence[str] = (), numeric: Sequence[str] = (),
                   max_categories: int = 20) -> tuple[list[str], list[str]]:
    """A16 rule: declared kinds win; an undeclared feature with at most 20 values is categorical."""
    open_ = [f for f in features if f not in categorical and f not in numeric]
    few: set[str] = set()
    if open_:
        rows = categorical_cardinality(df, open_).collect()
        few = {r["feature"] for r in rows if r["unique_count"] <= max_categories}
    few |= {f for f in open_ if not is_numeric(field_type(df, f))}
    cats = [f for f in features if f in categorical or f in few]
    return cats, [f for f in features if f not in cats]


def bivariate_profile(df: DataFrame, features: Sequence[str], target: str, task: str = "classification",
                      categorical: Sequence[str] = (), numeric: Sequence[str] = (), by: Sequence[str] = (),
                      exact: bool = False) -> DataFrame:
    """Target relation of every feature in one table."""
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task: {task}")
    cats, nums = route_features(df, features, categorical, numeric)
    on_cat, on_num = ((categorical_by_class, numeric_by_class) if task == "classification"
                      else (categorical_by_value, numeric_by_value))
    parts = []
    if cats:
        parts.append(on_cat(df, cats, target, by).withColumn("feature_type", F.lit("categorical")))
    if nums:
        parts.append(on_num(df, nums, target, by, exact).withColumn("feature_type", F.lit("numerical")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def size_profile(df: DataFrame) -> DataFrame:
    """A33 per column: type and estimated bytes per value, with the row count."""
    def size(f: str, t: T.DataType) -> list[Column]:
        if is_string(t):
            length = F.length(F.col(f"`{f}`"))
            est = (F.avg(length) + F.max(length)) / 2
        else:
            est = F.max(F.lit(TYPE_BYTES.get(t.typeName(), OTHER_TYPE_BYTES)))
        return [F.max(F.lit(t.typeName())).alias("data_type"), est.cast("double").alias("estimated_bytes"),
                F.count(F.lit(1)).alias("row_count")]
    return _per_feature(df, df.columns, (), size)


def table_size(df: DataFrame) -> DataFrame:
    """A33 summary: rows, columns, MB and size class of the table."""
    out = size_profile(df).agg(
        F.max("row_count").alias("row_count"), F.count(F.lit(1)).alias("column_count"),
        (F.sum("estimated_bytes") * F.max("row_count") / (1024 * 1024)).alias("total_size_mb"))
    cls = F.lit("huge")
    for name, top in reversed(SIZE_CLASSES_MB):
        cls = F.when(F.col("total_size_mb") < top, name).otherwise(cls)
    return out.withColumn("category", cls)


def complexity_score(df: DataFrame, high_cardinality: int = 1000, exact: bool = False) -> DataFrame:
    """0.1 per text column, 0.2 per text column over 1000 values, 0.1 per type; at most 1."""
    text = [f.name for f in df.schema if is_string(f.dataType)]
    kinds = len({f.dataType.typeName() for f in df.schema})
    if text:
        card = exact_cardinality(df, text) if exact else categorical_cardinality(df, text)
        many = card.agg(F.count_if(F.col("unique_count") > high_cardinality).alias("high_cardinality"))
    else:
        many = df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("high_cardinality"))
    score = 0.1 * len(text) + 0.1 * kinds + F.col("high_cardinality") * 0.2
    return many.select(F.lit(len(text)).alias("string_columns"), "high_cardinality", F.lit(kinds).alias("data_types"),
                       F.least(F.lit(1.0), score).alias("complexity_score"))


def dataset_size_class(df: DataFrame) -> DataFrame:
    """Small under 10 000 rows, medium under 100 000, else large."""
    n = F.col("row_count")
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "size_class", F.when(n < 10_000, "small").when(n < 100_000, "medium").otherwise("large"))


def full_profile(df: DataFrame, features: Sequence[str], target: str, task: str = "classification",
                 by: Sequence[str] = (), exact: bool = False) -> dict[str, DataFrame]:
    """The tidy tables ``univariate``, ``quality``, ``bivariate``, ``correlation``, ``matrix``, ``ranking`` and ``collinear``.

    With ``by=["dataset"]`` several datasets, unioned and tagged, are profiled
    in the same jobs.
    """
    from featurelens.operators.correlate import collinear_pairs, correlation_matrices, indexed_target, target_correlation, target_ranking
    numeric = [f for f in features if is_numeric(field_type(df, f))]
    tables = {
        "univariate": univariate_profile(df, features, by, exact),
        "bivariate": bivariate_profile(df, features, target, task, by=by, exact=exact),
    }
    tables["quality"] = quality_score(tables["univariate"], by)
    if numeric:
        tables["correlation"] = target_correlation(df, numeric, target, by)
        tables["matrix"] = correlation_matrices(indexed_target(df, target), [*numeric, target], by)
        tables["ranking"] = target_ranking(tables["matrix"], target)
        tables["collinear"] = collinear_pairs(tables["matrix"], numeric)
    return tables


def tag_datasets(datasets: dict[str, DataFrame]) -> DataFrame:
    """One frame of several datasets with a ``dataset`` column."""
    out = None
    for name, d in datasets.items():
        tagged = d.withColumn("dataset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no datasets given")
    return out
