"""Stored profile states: one small state per batch, merged later without the rows.

A state holds what merges without loss (row counts, moments, bounds, counts
per value) and two sketches: distinct values (HyperLogLog, standard error
under 1 %) and quantiles (KLL, rank error under 1 %).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from featurelens.functions.expressions import as_double, field_type, is_missing, null_if_missing
from featurelens.operators.drift import psi_from_shares
from featurelens.operators.joins import align_distributions
from featurelens.operators.profile import MISSING_BIN, QUARTILES, check_flat, melt_text
from featurelens.operators.shared import join_groups

QUANTILE_K = 1024
DISTINCT_LG_K = 14


@dataclass(frozen=True)
class ProfileState:
    """``columns``: a row per group and feature; ``values``: a row per group, categorical feature and value."""
    columns: DataFrame
    values: DataFrame


def take_state(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), by: Sequence[str] = ()) -> ProfileState:
    """The state of a batch, or of each group of it: one wide aggregation, and one count of the categorical values.

    Missing is null, NaN or blank text. An empty table gives a state of no rows (with ``by``: no state at all).
    """
    features = [*numeric, *categorical]
    if not features:
        raise ValueError("no features")
    check_flat(df, features)

    def one(f: str, number: bool) -> Column:
        kind = field_type(df, f)
        v = as_double(f, kind) if number else F.lit(None).cast("double")
        plain = null_if_missing(f, kind)
        direct = isinstance(kind, (T.IntegerType, T.LongType, T.StringType))
        return F.struct(
            F.lit(f).alias("feature"), F.lit("numeric" if number else "categorical").alias("kind"), F.count(F.lit(1)).alias("rows"),
            F.count_if(is_missing(f, kind)).alias("missing"), F.count(v).alias("n"), F.avg(v).alias("mean"),
            (F.var_pop(v) * F.count(v)).alias("m2"), F.min(v).alias("low"), F.max(v).alias("high"),
            (F.kll_sketch_agg_double(v, QUANTILE_K) if number else F.lit(None).cast("binary")).alias("ranks"),
            F.hll_sketch_agg(plain if direct else plain.cast("string"), F.lit(DISTINCT_LG_K)).alias("distinct"))

    rows = F.array(*[one(f, True) for f in numeric], *[one(f, False) for f in categorical])
    columns = df.groupBy(*by).agg(rows.alias("_rows")).select(*by, F.inline("_rows"))
    if categorical:
        values = melt_text(df, categorical, by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    else:
        values = df.select(*by).limit(0).select(*by, F.lit("").alias("feature"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n"))
    return ProfileState(columns, values)


def merge_states(state: ProfileState, by: Sequence[str] = ()) -> ProfileState:
    """The state of all rows of each group of ``by``, a part of the state's own keys; counts, moments and bounds stay exact."""
    keys = [*by, "feature", "kind"]
    n = F.sum("n")
    mean = state.columns.groupBy(*keys).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), n).alias("_mean"))
    columns = join_groups(state.columns, mean, keys)
    # squares around the common mean: no difference of large sums
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean"))
    columns = columns.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), n.alias("n"), F.first("_mean").alias("mean"), F.sum(apart).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("ranks", QUANTILE_K).alias("ranks"),
        F.hll_union_agg("distinct").alias("distinct"))
    return ProfileState(columns, state.values.groupBy(*by, "feature", "value").agg(F.sum("n").alias("n")))


def write_state(state: ProfileState, path: str, batch: str) -> None:
    """Store the state of one batch beside the others; a batch that is written again replaces its old state."""
    for name, table in (("columns", state.columns), ("values", state.values)):
        table.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/{name}/{quote(batch, safe='')}")


def read_states(spark: SparkSession, path: str, batches: Sequence[str] | None = None) -> ProfileState:
    """The stored states, all or those of some batches, with their ``batch`` as a column."""
    def table(name: str) -> DataFrame:
        folders = [f"{path}/{name}/*"] if batches is None else [f"{path}/{name}/{quote(b, safe='')}" for b in batches]
        return spark.read.parquet(*folders)
    return ProfileState(table("columns"), table("values"))


def profile_of_state(state: ProfileState) -> DataFrame:
    """A2-A5 from a state: exact counts, mean, deviation and bounds; quartiles and distinct count within the sketches' error.

    A feature without values has null figures and a distinct count of 0.
    """
    keys = [c for c in state.columns.columns if c not in ("feature", "kind", "rows", "missing", "n", "mean", "m2", "low", "high", "ranks", "distinct")]
    held = (F.col("kind") == "numeric") & (F.col("n") > 0)
    quartiles = [F.when(held, F.kll_sketch_get_quantile_double("ranks", F.lit(p))).alias(name) for p, name in QUARTILES.items()]
    return state.columns.select(
        *keys, "feature", "kind", F.col("rows").alias("total_rows"), F.col("missing").alias("missing_count"),
        F.try_divide(F.col("missing"), F.col("rows")).alias("missing_fraction"), "mean",
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("stddev"), F.col("low").alias("min"), F.col("high").alias("max"),
        *quartiles, F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0).cast("bigint")).alias("unique_count"))


def psi_of_states(expected: ProfileState, actual: ProfileState, bins: int = 10) -> DataFrame:
    """A17, A18 from two merged states: ``feature, psi``.

    Numeric bins end at the quantiles of ``expected`` and hold their upper edge; missing values are a bin of their own.
    Categorical shares come from the exact counts. Sketches of one plan differ slightly from run to run, so compare stored
    states; those of the same rows then have a PSI of 0. Features of one state only are left out; so are features of a state without rows.
    """
    e = expected.columns.where("rows > 0").select("feature", "kind", "rows", "missing", "n", "ranks")
    a = actual.columns.where("rows > 0").select("feature", "kind", *[F.col(c).alias(f"_{c}") for c in ("rows", "missing", "n", "ranks")])
    both = e.join(a, ["feature", "kind"])
    numeric = both.where("kind = 'numeric'")
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    # a few numbers for each feature
    edges = {r["feature"]: sorted(set(r["q"] or [])) for r in numeric.select(
        "feature", F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("ranks", probs)).alias("q")).collect()}

    def shares(ranks: str, n: str, missing: str, rows: str) -> Column:
        """Shares of the bins up to each edge, above the last edge, and of missing values."""
        upto = F.array().cast("array<double>")
        for f, cuts in edges.items():
            if cuts:
                held = F.kll_sketch_get_rank_double(ranks, F.array(*[F.lit(c) for c in cuts]))
                upto = F.when(F.col("feature") == f, F.when(F.col(n) > 0, held).otherwise(F.array(*[F.lit(0.0)] * len(cuts)))).otherwise(upto)
        ends = F.concat(F.array(F.lit(0.0)), upto, F.array(F.lit(1.0)))
        part = F.zip_with(F.slice(ends, 2, F.size(ends) - 1), F.slice(ends, 1, F.size(ends) - 1), lambda high, low: (high - low) * F.col(n) / F.col(rows))
        return F.concat(part, F.array(F.col(missing) / F.col(rows)))

    wide = numeric.select("feature", shares("ranks", "n", "missing", "rows").alias("expected"), shares("_ranks", "_n", "_missing", "_rows").alias("actual"))
    wide = wide.select("feature", F.inline(F.arrays_zip("expected", "actual")))

    def counted(state: ProfileState, rows: str) -> DataFrame:
        named = state.values.join(both.where("kind = 'categorical'").select("feature", F.col(rows).alias("_total")), "feature")
        return named.select("feature", F.coalesce("value", F.lit(MISSING_BIN)).alias("bin"), (F.col("n") / F.col("_total")).alias("share"))

    aligned = align_distributions(counted(expected, "rows"), counted(actual, "_rows"), ["feature", "bin"])
    return psi_from_shares(wide.select("feature", "expected", "actual").unionByName(aligned.select("feature", "expected", "actual")))
