"""Pearson correlations: matrix, target ranking and collinear pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from featurelens.functions.expressions import as_double, field_type, is_numeric, safe_corr
from featurelens.operators.moments import co_moments, correlation
from featurelens.operators.shared import SMALL_FRAME_ROWS, ensure_checkpoint_dir, pin_small

# Least |r| of each strength label.
STRENGTHS = [("very_strong", 0.8), ("strong", 0.6), ("moderate", 0.4), ("weak", 0.2)]


def indexed_target(df: DataFrame, target: str) -> DataFrame:
    """Text target to a number by frequency rank (ties by value); numeric is kept."""
    if is_numeric(field_type(df, target)):
        return df
    from featurelens.operators.transform import frequency_index
    return frequency_index(df, target, target)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature1, feature2, correlation`` for every pair, on complete rows.

    One scan makes the matrix of co-moments, which is kept: only columns by columns reach the driver, or the shared folder for wide
    tables. A constant column has no correlation with another: null.
    """
    clean = df.select(*[as_double(c, field_type(df, c)).alias(c) for c in columns]).dropna()
    r = F.when(F.col("feature1") == F.col("feature2"), F.lit(1.0)).otherwise(correlation())
    found = co_moments(clean, columns).select("feature1", "feature2", r.alias("correlation"))
    if len(columns) ** 2 <= SMALL_FRAME_ROWS:
        return pin_small(found)[0]
    ensure_checkpoint_dir(df.sparkSession)
    return found.checkpoint()


def correlation_matrices(df: DataFrame, columns: Sequence[str], by: Sequence[str], width: int = 100) -> DataFrame:
    """A20 for every group at once: ``*by, feature1, feature2, correlation`` on complete rows."""
    clean = df.select(*by, *[as_double(c, field_type(df, c)).alias(c) for c in columns]).dropna(subset=list(columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    out = None
    for i in range(0, len(pairs), width):
        rows = F.array(*[F.struct(F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), safe_corr(F.col(a), F.col(b)).alias("correlation")) for a, b in pairs[i:i + width]])
        part = clean.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.inline("_rows"))
        out = part if out is None else out.unionByName(part)
    mirrored = out.where(F.col("feature1") != F.col("feature2")).select(*by, F.col("feature2").alias("feature1"), F.col("feature1").alias("feature2"), "correlation")
    return out.unionByName(mirrored)


def strength(r: Column) -> Column:
    label = F.lit("very_weak")
    for name, floor in reversed(STRENGTHS):
        label = F.when(F.abs(r) >= floor, name).otherwise(label)
    return F.when(r.isNull(), "undefined").otherwise(label)


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").when(r < 0, "negative").otherwise("none")


def with_strength(corr: DataFrame) -> DataFrame:
    r = F.col("correlation")
    return corr.withColumn("abs_correlation", F.abs(r)).withColumn("strength", strength(r)).withColumn(
        "relationship_type", direction(r))


def target_ranking(matrix: DataFrame, target: str) -> DataFrame:
    """The target row of a matrix with strength and sign, strongest first."""
    groups = [c for c in matrix.columns if c not in ("feature1", "feature2", "correlation")]
    rows = matrix.where((F.col("feature2") == target) & (F.col("feature1") != target)).select(
        *groups, F.col("feature1").alias("feature"), "correlation")
    return with_strength(rows).orderBy(F.desc("abs_correlation"), "feature")


def collinear_pairs(matrix: DataFrame, features: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Unordered pairs of features with |r| over ``threshold``."""
    keep = list(features)
    return matrix.where(
        F.col("feature1").isin(keep) & F.col("feature2").isin(keep) & (F.col("feature1") < F.col("feature2"))
        & (F.abs("correlation") > threshold)
    ).withColumn("abs_correlation", F.abs("correlation")).orderBy(F.desc("abs_correlation"), "feature1", "feature2")


def collinearity_summary(pairs: DataFrame) -> DataFrame:
    """A22 flag: number of collinear pairs and a warning."""
    return pairs.agg(F.count(F.lit(1)).alias("multicollinearity_count")).withColumn(
        "multicollinearity_warning", F.col("multicollinearity_count") > 0)


def target_correlation(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of every feature with the target in one aggregation."""
    df = indexed_target(df, target)
    y = as_double(target, field_type(df, target))
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), safe_corr(as_double(f, field_type(df, f)), y).alias("correlation"))
        for f in features])
    out = df.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.inline("_rows"))
    return with_strength(out)
