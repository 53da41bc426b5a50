"""Column expressions shared by the operators. All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text tokens read as "no number".
NULL_TOKENS = ["", "?", "NA", "NULL"]
NOT_NUMERIC_CHARS = "[^0-9.-]"


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_missing(name: str, dtype: T.DataType) -> Column:
    """Null, NaN (floating types) or blank text (string types)."""
    c = F.col(f"`{name}`")
    if is_string(dtype):
        return c.isNull() | (F.trim(c) == "")
    if is_floating(dtype):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_if_missing(name: str, dtype: T.DataType) -> Column:
    return F.when(~is_missing(name, dtype), F.col(f"`{name}`"))


def as_double(name: str, dtype: T.DataType) -> Column:
    """Numeric view of a column with every missing form as null."""
    if is_string(dtype):
        return null_if_missing(name, dtype).cast("double")
    value = F.col(f"`{name}`").cast("double")
    # evaluates the column once, which matters for computed columns
    return F.nanvl(value, F.lit(None).cast("double")) if is_floating(dtype) else value


def coerce_number(name: str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Text to double: null tokens give null, other characters are stripped."""
    c = F.col(f"`{name}`")
    stripped = F.regexp_replace(c, NOT_NUMERIC_CHARS, "")
    return F.when(~F.trim(c).isin(list(tokens)), stripped.try_cast("double"))


def unit_hash(*keys: str | Column, seed: int = 12345) -> Column:
    """A number in [0, 1) that depends only on the seed and the row key."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def bucket_tree(value: Column, cuts: Sequence[float]) -> Column:
    """Number of ``cuts`` (ascending) at or below ``value``, as nested tests."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(float(cuts[mid])), build(lo, mid)).otherwise(build(mid + 1, hi))

    return build(0, len(cuts))


def approx_distinct(value: Column, dtype: T.DataType) -> Column:
    """Distinct count by a HyperLogLog sketch (standard error under 1 %); nulls do not count."""
    direct = isinstance(dtype, (T.IntegerType, T.LongType, T.StringType))
    sketch = F.hll_sketch_agg(value if direct else value.cast("string"), F.lit(14))
    return F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0).cast("bigint"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the complete pairs; null for a constant side.

    The built-in ``corr`` raises on a zero variance in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
