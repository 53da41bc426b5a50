"""Key joins. Positional row ids are never used as join keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from featurelens.operators.shared import pin_small

HOT_KEY_SHARE = 500          # a key with more than 1/500 of the rows is hot
SALTS = 64
SALT_OVER_ROWS = 1_000_000   # a smaller left side fits one task even if it is one key


def join_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Attach ``right`` to ``left`` by real key columns. Skewed keys: ``salted_join``."""
    return left.join(right, list(keys), how)


def _blank(keys: Sequence[str]) -> Column:
    return reduce(or_, [F.col(f"`{k}`").isNull() for k in keys])


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the rows: Spark may not send one of them through the driver."""
    return left.join(right.hint("merge"), list(keys), how)


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
    salt_by: Sequence[str] | None = None, salt_over: int = SALT_OVER_ROWS, spread: bool = False,
) -> DataFrame:
    """J1 for skewed keys: only the hot keys of ``left`` and its null keys are salted.

    At most ``HOT_KEY_SHARE`` keys can each hold more than that share of the
    rows, so the list of hot keys has a proven bound. A null key matches
    nothing; its rows are dealt over all tasks. ``how`` is inner or left. With ``spread`` the right side grows with
    the rows too: it goes from task to task and never through the driver.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    keys = list(keys)
    if spread:
        right = right.hint("merge")
    total = left.count()
    if total <= salt_over:
        return left.join(right, keys, how)
    hot = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > total / HOT_KEY_SHARE)
    hot, rows = pin_small(hot.select(*keys, F.lit(True).alias("_hot")), HOT_KEY_SHARE)
    if not rows:
        return left.join(right, keys, how)
    salt_cols = list(salt_by or left.columns)
    tagged = left.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_hot") | _blank(keys), F.pmod(F.xxhash64(*salt_cols, F.spark_partition_id()), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    copies = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    copies = copies.drop("_hot").hint("merge") if spread else copies.drop("_hot")
    return tagged.drop("_hot").join(copies, [*keys, "_salt"], how).drop("_salt")


def attach_labels(rows: DataFrame, labels: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Attach labels or predictions by a stable row key (left join).

    A row key is nearly unique, so only a null one can be hot. It matches nothing, so its rows are dealt over all tasks.
    """
    key = [key] if isinstance(key, str) else list(key)
    plain = [f"`{f.name}`" for f in rows.schema if isinstance(f.dataType, T.AtomicType)]
    deal = F.when(_blank(key), F.pmod(F.xxhash64(*plain), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    return rows.withColumn("_salt", deal).join(labels.withColumn("_salt", F.lit(0)), [*key, "_salt"], "left").drop("_salt")


def align_distributions(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "share") -> DataFrame:
    """Full outer join of two distributions; the missing side counts 0."""
    e = expected.select(*keys, F.col(value).alias("expected"))
    a = actual.select(*keys, F.col(value).alias("actual"))
    return e.join(a, list(keys), "full_outer").select(
        *keys, F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("actual", F.lit(0.0)).alias("actual"))
