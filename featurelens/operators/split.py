"""Splits, folds and samples. The default is a hash of the row key: the same
rows land in the same part for any partitioning, machine or repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from featurelens.functions.expressions import bucket_tree, unit_hash

# Feature-selection sample fractions by table size class.
SAMPLE_FRACTIONS = {"small": 1.0, "medium": 0.3, "large": 0.1}


def with_split(df: DataFrame, key: str | Sequence[str], sizes: dict[str, float], seed: int = 12345) -> DataFrame:
    """B1: ``dataset`` column by cumulated shares of the key hash."""
    keys = [key] if isinstance(key, str) else list(key)
    total = sum(sizes.values())
    if total > 1.0 + 1e-9 or any(v < 0 for v in sizes.values()):
        raise ValueError("split sizes must be positive and sum to at most 1")
    names, cuts, acc = list(sizes), [], 0.0
    for v in sizes.values():
        acc += v
        cuts.append(acc)
    if abs(acc - 1.0) < 1e-9:
        cuts = cuts[:-1]
    index = bucket_tree(unit_hash(*keys, seed=seed), cuts)
    labels = F.array(*[F.lit(n) for n in names])
    return df.withColumn("dataset", F.get(labels, index))


def train_valid_test(df: DataFrame, key: str | Sequence[str], train: float = 0.4, valid: float = 0.3,
                     seed: int = 12345) -> dict[str, DataFrame]:
    """B1: three disjoint frames, complete together."""
    tagged = with_split(df, key, {"train": train, "valid": valid, "test": 1.0 - train - valid}, seed)
    return {n: tagged.where(F.col("dataset") == n).drop("dataset") for n in ("train", "valid", "test")}


def clustering_split(df: DataFrame, key: str | Sequence[str], train: float = 0.7, valid: float = 0.2, test: float = 0.1,
                     seed: int = 42) -> DataFrame:
    """B2: ratios are brought to sum 1 before the split."""
    total = train + valid + test
    return with_split(df, key, {"train": train / total, "valid": valid / total, "test": test / total}, seed)


def with_folds(df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, usable as ``CrossValidator(foldCol=...)``."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("fold", F.floor(unit_hash(*keys, seed=seed) * k).cast("int"))


def hash_sample(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose key hash is under ``fraction``: the same rows for any partitioning."""
    keys = [key] if isinstance(key, str) else list(key)
    return df if fraction >= 1.0 else df.where(unit_hash(*keys, seed=seed) < fraction)


def selection_sample(df: DataFrame, key: str | Sequence[str], size_class: str, seed: int = 42) -> DataFrame:
    """Sample for feature selection by size class, on request."""
    return hash_sample(df, key, SAMPLE_FRACTIONS[size_class], seed)


def large_table_fraction(rows: int, task: str = "classification") -> float:
    """B7 rule: 5 % within 500 000 to 1 000 000 rows over 5 million rows;
    regression: 10 % but at most 100 000 rows over 500 000 rows."""
    if task == "classification":
        return 1.0 if rows <= 5_000_000 else min(1_000_000, max(500_000, int(rows * 0.05))) / rows
    return 1.0 if rows <= 500_000 else min(100_000, int(rows * 0.1)) / rows


def large_table_sample(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Sample of a very large table before feature selection; the caller names the fraction (``large_table_fraction`` gives one)."""
    return hash_sample(df, key, fraction, seed)


def union_parts(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
