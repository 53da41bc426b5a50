"""Regression metrics and residual tables from a prediction frame."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from featurelens.functions.expressions import safe_corr, unit_hash
from featurelens.operators.binary_metrics import to_metric_rows
from featurelens.operators.columns import clean_predictions
from featurelens.operators.quantiles import exact_quantiles, quantile_columns
from featurelens.operators.shared import join_groups, local_frame, pin_small

ZERO_GUARD = 1e-8


def _basic(target: str, prediction: str) -> tuple[list[Column], dict[str, Column]]:
    """Aggregates and the columns made from them."""
    y, e = F.col(target), F.col(target) - F.col(prediction)
    return ([F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_v")],
            {"rmse": F.sqrt("mse"), "r2": 1 - F.try_divide("mse", "_v")})


def _percentage(target: str, prediction: str) -> tuple[list[Column], dict[str, Column]]:
    y, e = F.col(target), F.col(target) - F.col(prediction)
    base = F.when(y == 0, F.lit(ZERO_GUARD)).otherwise(y)
    return ([(F.avg(F.abs(e / base)) * 100).alias("mape"), F.var_pop(e).alias("_e"), F.var_pop(y).alias("_y")],
            {"explained_variance": 1 - F.try_divide("_e", "_y")})


def _extended(target: str, prediction: str, exact: bool) -> list[Column]:
    y, p = F.col(target), F.col(prediction)
    e = y - p
    log_ok = (y > -1) & (p > -1)
    # log1p is only evaluated where it is defined
    sq = F.when(log_ok, F.pow(F.log1p(F.greatest(y, F.lit(-0.999999999))) - F.log1p(F.greatest(p, F.lit(-0.999999999))), 2))
    return [F.max(F.abs(e)).alias("max_error"), F.avg(sq).alias("msle"),
            F.avg(e).alias("residual_mean"), F.stddev(e).alias("residual_std"),
            F.skewness(e).alias("residual_skewness"), F.kurtosis(e).alias("residual_kurtosis"),
            F.avg(p).alias("prediction_mean"), F.stddev(p).alias("prediction_std"),
            F.avg(y).alias("actual_mean"), F.stddev(y).alias("actual_std"), F.count(F.lit(1)).alias("n_samples"),
            *([] if exact else [F.percentile_approx(F.abs(e), 0.5, 10_000).alias("median_absolute_error")])]


def _exact_median(df: DataFrame, out: DataFrame, target: str, prediction: str, by: list[str]) -> DataFrame:
    q = exact_quantiles(df.select(*by, F.abs(F.col(target) - F.col(prediction)).alias("_e")), by, "_e", [0.5])
    med = quantile_columns(q, by, {0.5: "median_absolute_error"})
    return join_groups(out, med, by) if by else out.withColumn("_k", F.lit(1)).join(med.withColumn("_k", F.lit(1)), "_k").drop("_k")


def basic_metrics(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2, MSE in one aggregation."""
    sums, made = _basic(target, prediction)
    return df.groupBy(*by).agg(*sums).withColumns(made).select(*by, "rmse", "mae", "r2", "mse")


def percentage_metrics(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """MAPE (zero actual counts as 1e-8) and explained variance."""
    sums, made = _percentage(target, prediction)
    return df.groupBy(*by).agg(*sums).withColumns(made).select(*by, "mape", "explained_variance")


def extended_metrics(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Max error, median absolute error, MSLE, residual shape, means, deviations and count.

    MSLE uses rows where both sides exceed -1. Skewness and kurtosis are the population forms.
    """
    by = list(by)
    out = df.groupBy(*by).agg(*_extended(target, prediction, exact))
    return _exact_median(df, out, target, prediction, by) if exact else out


ERROR_PROBS = {0.5: "median", 0.9: "p90", 0.95: "p95", 0.99: "p99"}


def error_summary(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Mean, median, max and high percentiles of absolute and relative (percent) error."""
    by = list(by)
    y = F.abs(F.col(target))
    a = F.abs(F.col(target) - F.col(prediction))
    r = a / F.when(y > ZERO_GUARD, y).otherwise(F.lit(ZERO_GUARD)) * 100
    long = df.select(*by, a.alias("absolute"), r.alias("relative")).unpivot(by, ["absolute", "relative"], "error", "value")
    keys = [*by, "error"]
    base = [F.avg("value").alias("mean"), F.max("value").alias("max")]
    if exact:
        q = quantile_columns(exact_quantiles(long, keys, "value", list(ERROR_PROBS)), keys, ERROR_PROBS)
        return join_groups(long.groupBy(*keys).agg(*base), q, keys)
    sketch = F.percentile_approx("value", list(ERROR_PROBS), 10_000)
    out = long.groupBy(*keys).agg(*base, sketch.alias("_q"))
    return out.select(*keys, "mean", "max", *[F.col("_q").getItem(i).alias(n) for i, n in enumerate(ERROR_PROBS.values())])


def residual_histogram(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Equal-width residual counts with bin bounds and the fitted normal mean and std."""
    by = list(by)
    slim = df.select(*by, (F.col(target) - F.col(prediction)).alias("_e"))
    span, rows = pin_small(slim.groupBy(*by).agg(
        F.min("_e").alias("_lo"), F.max("_e").alias("_hi"), F.avg("_e").alias("residual_mean"), F.stddev("_e").alias("residual_std")))
    if by:
        joined = join_groups(slim, span, by)
    else:
        joined = slim.withColumns({c: F.lit(rows[0][c]) for c in ("_lo", "_hi", "residual_mean", "residual_std")})
    width = (F.col("_hi") - F.col("_lo")) / bins
    index = F.least(F.floor(F.coalesce(F.try_divide(F.col("_e") - F.col("_lo"), width), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return joined.groupBy(*by, index.alias("bin"), "_lo", "_hi", "residual_mean", "residual_std").agg(F.count(F.lit(1)).alias("count")).select(
        *by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        "count", "residual_mean", "residual_std")


def residual_trend(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of the residual on the prediction."""
    e, p = F.col(target) - F.col(prediction), F.col(prediction)
    return df.groupBy(*by).agg(F.regr_slope(e, p).alias("slope"), F.regr_intercept(e, p).alias("intercept"), F.count(F.lit(1)).alias("n"))


def qq_table(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = (), points: int = 99, exact: bool = False) -> DataFrame:
    """Sample and normal quantiles of the residuals at ``points`` inner probabilities."""
    by = list(by)
    probs = [i / (points + 1) for i in range(1, points + 1)]
    slim = df.select(*by, (F.col(target) - F.col(prediction)).alias("_e"))
    spark = df.sparkSession
    normal = local_frame(spark, [(p, NormalDist().inv_cdf(p)) for p in probs], "p double, theoretical double")
    if exact:
        q = exact_quantiles(slim, by, "_e", probs).select(*by, "p", F.col("q").alias("sample"))
    else:
        arrays = slim.groupBy(*by).agg(F.percentile_approx("_e", probs, 10_000).alias("_q"))
        q = arrays.select(*by, F.posexplode("_q").alias("_i", "sample")).withColumn("p", (F.col("_i") + 1) / F.lit(points + 1)).drop("_i")
    return q.join(normal, "p")


def qq_fit(qq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R2 of the Q-Q line."""
    return qq.groupBy(*by).agg(F.pow(safe_corr(F.col("theoretical"), F.col("sample")), 2).alias("qq_r2"))


def sample_points(df: DataFrame, target: str, key: str | Sequence[str], prediction: str = "prediction", by: Sequence[str] = (),
                  n: int = 1000, seed: int = 42) -> DataFrame:
    """About ``n`` actual/predicted points per group, chosen by the key hash."""
    by = list(by)
    keys = [key] if isinstance(key, str) else list(key)
    sizes, rows = pin_small(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    joined = join_groups(df, sizes, by) if by else df.withColumn("_n", F.lit(rows[0]["_n"]))
    return joined.where(unit_hash(*keys, seed=seed) < F.lit(float(n)) / F.col("_n")).select(
        *by, *keys, F.col(target).alias("actual"), F.col(prediction).alias("predicted"))


METRICS = ["rmse", "mae", "r2", "mse", "mape", "explained_variance", "max_error", "msle", "median_absolute_error", "residual_mean", "residual_std"]


def validate_regression(df: DataFrame, target: str, prediction: str = "prediction", by: Sequence[str] = ("dataset",), exact: bool = False) -> DataFrame:
    """Metric rows of E8-E10 per group after dropping unusable rows (P8), from one aggregation; ``exact`` reads the rows again for the median."""
    by = list(by)
    clean = clean_predictions(df, target, prediction).select(*by, target, prediction)
    if exact:
        clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        (basic, made), (percentage, more) = _basic(target, prediction), _percentage(target, prediction)
        wide = clean.groupBy(*by).agg(*basic, *percentage, *_extended(target, prediction, exact)).withColumns(made | more)
        if exact:
            wide = _exact_median(clean, wide, target, prediction, by)
        return pin_small(to_metric_rows(wide, by, METRICS))[0]
    finally:
        if exact:
            clean.unpersist()
