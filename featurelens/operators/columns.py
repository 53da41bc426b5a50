"""Column decisions: which columns stay, and why."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from featurelens.functions.expressions import (
    NULL_TOKENS, approx_distinct, coerce_number, field_type, is_missing, is_numeric, is_string, null_if_missing, unit_hash,
)
from featurelens.operators.shared import local_frame
from featurelens.operators.profile import categorical_cardinality, exact_cardinality, missing_counts

# Name parts that hint at a date, and the shapes of a date text.
DATE_NAME_PARTS = ["date", "time", "dt_", "_dt", "timestamp"]
DATE_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{4}/\d{2}/\d{2}", r"\d{2}-\d{2}-\d{4}", r"^\d{10,13}$"]
# Names never used as clustering features.
ID_NAMES = ["id", "index", "row_id", "row_number"]

DECISION_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("kept", T.BooleanType()), T.StructField("reason", T.StringType())])


def pick_columns(
    columns: Sequence[str], include: Sequence[str] = (), include_prefix: Sequence[str] = (),
    include_suffix: Sequence[str] = (), exclude: Sequence[str] = (), exclude_prefix: Sequence[str] = (),
    exclude_suffix: Sequence[str] = (), target: str | None = None,
) -> list[str]:
    """Names, prefixes and suffixes narrow the list in turn, then exclusions apply; order is kept."""
    out = [c for c in columns if c != target]
    if include:
        out = [c for c in out if c in set(include)]
    if include_prefix:
        out = [c for c in out if c.startswith(tuple(include_prefix))]
    if include_suffix:
        out = [c for c in out if c.endswith(tuple(include_suffix))]
    out = [c for c in out if c not in set(exclude)]
    if exclude_prefix:
        out = [c for c in out if not c.startswith(tuple(exclude_prefix))]
    if exclude_suffix:
        out = [c for c in out if not c.endswith(tuple(exclude_suffix))]
    return out


def date_columns(df: DataFrame, columns: Sequence[str], share: float = 0.5) -> dict[str, str]:
    """``{column: reason}`` of date columns, by type or by name and content (one job)."""
    found = {c: f"type {field_type(df, c).simpleString()}" for c in columns
             if is_date(field_type(df, c))}
    hinted = [c for c in columns if c not in found and any(p in c.lower() for p in DATE_NAME_PARTS)]
    if hinted:
        shape = "|".join(f"({p})" for p in DATE_PATTERNS)
        row = df.agg(*[F.avg(F.col(f"`{c}`").cast("string").rlike(shape).cast("int")).alias(c) for c in hinted]).first()
        found |= {c: "date pattern" for c in hinted if row[c] is not None and row[c] > share}
    return found


def low_missing_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.75) -> list[str]:
    """Columns whose missing fraction is at most ``threshold``."""
    rows = missing_counts(df, columns).collect()
    good = {r["feature"] for r in rows if r["missing_fraction"] is None or r["missing_fraction"] <= threshold}
    return [c for c in columns if c in good]


def split_by_kind(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[list[str], list[str]]:
    """(categorical, numeric); nested types are refused."""
    columns = list(columns or df.columns)
    nested = [c for c in columns if isinstance(field_type(df, c), (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise TypeError(f"nested columns are not features: {nested}")
    cats = [c for c in columns if is_string(field_type(df, c))]
    return cats, [c for c in columns if c not in cats]


def low_cardinality_columns(df: DataFrame, columns: Sequence[str], limit: int = 50, exact: bool = False) -> list[str]:
    """P5: categorical columns with at most ``limit`` distinct values."""
    if not columns:
        return []
    table = exact_cardinality(df, columns) if exact else categorical_cardinality(df, columns)
    good = {r["feature"] for r in table.collect() if r["unique_count"] <= limit}
    return [c for c in columns if c in good]


def coerce_columns(df: DataFrame, columns: Sequence[str], tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Text columns to double in place; columns that are not text are cast."""
    return df.withColumns({
        c: coerce_number(c, tokens) if is_string(field_type(df, c)) else F.col(f"`{c}`").try_cast("double") for c in columns})


def clean_numeric_target(df: DataFrame, target: str) -> DataFrame:
    """Target as double without null, blank, unreadable or NaN rows; raises if nothing is left."""
    out = df.withColumn(target, F.col(f"`{target}`").try_cast("double"))
    out = out.where(F.col(target).isNotNull() & ~F.isnan(target))
    if out.isEmpty():
        raise ValueError(f"no usable values in target {target!r}")
    return out


def clean_predictions(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Rows whose target and prediction are both real numbers."""
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    return df.where(y.isNotNull() & ~F.isnan(y) & p.isNotNull() & ~F.isnan(p))


def sample_rows(df: DataFrame, key: str | Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """Row sample before preprocessing, by key hash."""
    keys = [key] if isinstance(key, str) else list(key)
    return df if fraction >= 1.0 else df.where(unit_hash(*keys, seed=seed) < fraction)


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """P10: only numeric types."""
    return [c for c in (columns or df.columns) if is_numeric(field_type(df, c))]


def clustering_columns(df: DataFrame, target: str | None = None) -> tuple[list[str], list[str]]:
    """(categorical, numeric) without id-like names and without the target."""
    keep = [c for c in df.columns if c.lower() not in ID_NAMES and c != target]
    keep = [c for c in keep if is_numeric(field_type(df, c)) or is_string(field_type(df, c))]
    return split_by_kind(df, keep)


def encoded_name(column: str, suffix: str = "_encoded") -> str:
    return column + suffix


def raw_name(column: str, suffixes: Sequence[str] = ("_encoded", "_index")) -> str:
    for s in suffixes:
        if column.endswith(s):
            return column[: -len(s)]
    return column


def rename_encoded(df: DataFrame, columns: Sequence[str], old: str = "_index", new: str = "_encoded") -> DataFrame:
    """``x_index`` becomes ``x_encoded``."""
    return df.withColumnsRenamed({c + old: c + new for c in columns})


def suggest_target(df: DataFrame, task: str = "classification") -> str:
    """First two-valued column, else first text column, else the last; regression: first numeric."""
    if task == "regression":
        nums = numeric_columns(df)
        return nums[0] if nums else df.columns[-1]
    row = df.agg(*[approx_distinct(F.col(f"`{c}`"), field_type(df, c)).alias(c) for c in df.columns]).first()
    few = [c for c in df.columns if row[c] <= 4]
    if few:
        sure = df.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in few]).first()
        two = [c for c in few if sure[c] == 2]
        if two:
            return two[0]
    text = [c for c in df.columns if is_string(field_type(df, c))]
    return text[0] if text else df.columns[-1]


def keep_encoded(df: DataFrame, features: Sequence[str], target: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Selected feature columns (plus keys and target); raw categoricals are dropped."""
    return df.select(*keys, *features, *([target] if target else []))


def column_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Missing share, distinct count (text) and share of date shapes (hinted names) of all columns in one scan."""
    if not columns:
        return {}
    shape = "|".join(f"({p})" for p in DATE_PATTERNS)
    aggs = []
    for c in columns:
        t = field_type(df, c)
        hinted = any(p in c.lower() for p in DATE_NAME_PARTS)
        date = F.avg(F.col(f"`{c}`").cast("string").rlike(shape).cast("int")) if hinted else F.lit(None).cast("double")
        distinct = approx_distinct(null_if_missing(c, t), t) if is_string(t) else F.lit(None).cast("bigint")
        missing = F.try_divide(F.count_if(is_missing(c, t)), F.count(F.lit(1)))
        aggs.append(F.struct(missing.alias("missing"), distinct.alias("distinct"), date.alias("date_share")).alias(c))
    row = df.agg(*aggs).first()
    return {c: row[c].asDict() for c in columns}


def is_date(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def decisions(spark, columns: Sequence[str], kept: Sequence[str], reason: str) -> DataFrame:
    """Column decisions as rows ``(column, kept, reason)``."""
    keep = set(kept)
    return local_frame(spark, [(c, c in keep, None if c in keep else reason) for c in columns], DECISION_SCHEMA)
