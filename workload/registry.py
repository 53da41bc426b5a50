"""Registry of the queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# a shift far under the kept digits: exact decimal halves (means of prices) no
# longer lie on the rounding edge, where two engines may differ in the last bit
SHIFT = 3.1e-8


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column (plus 0.0, so that there is no negative zero)."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`") + F.lit(SHIFT), special.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def r(expr: str, digits: int = 6) -> str:
    """SQL counterpart of ``rounded``."""
    return f"(round(CAST({expr} AS DOUBLE) + CAST('{SHIFT}' AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"
