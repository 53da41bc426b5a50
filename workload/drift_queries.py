"""Drift and dataset comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import compare as K, correlate as C, drift as D, profile as P, states as ST
from workload import fixtures as X
from workload.fixtures import sql
from featurelens.operators.shared import fresh_path
from workload.registry import query, r, rounded

NUMERIC = ["price", "balance", "nation"]
CATEGORICAL = ["priority", "segment_gaps"]
DATASETS = ["train", "oot1", "oot2"]


def _binned(e: str, a: str, numeric, categorical) -> dict[str, str]:
    """Counts per feature and bin of two datasets; numeric edges come from the first."""
    out = {}
    nl = " UNION ALL ".join(f"SELECT dataset, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM labelled WHERE dataset IN ('{e}', '{a}')" for c in numeric)
    out[f"nl_{e}_{a}"] = nl or "SELECT NULL AS dataset, NULL AS feature, CAST(NULL AS DOUBLE) AS v WHERE false"
    probs = ", ".join(str(i / 10) for i in range(1, 10))
    out[f"ed_{e}_{a}"] = (f"SELECT feature, list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS edges FROM nl_{e}_{a} WHERE dataset = '{e}' GROUP BY feature")
    bins = [f"SELECT n.dataset, n.feature, CAST(len(list_filter(edges, lambda x: x <= v)) AS VARCHAR) AS bin FROM nl_{e}_{a} n JOIN ed_{e}_{a} d ON n.feature = d.feature"]
    bins += [f"SELECT dataset, '{c}' AS feature, coalesce(CAST({c} AS VARCHAR), '(missing)') AS bin FROM labelled WHERE dataset IN ('{e}', '{a}')" for c in categorical]
    out[f"sh_{e}_{a}"] = ("SELECT dataset, feature, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY dataset, feature) AS DOUBLE) AS share FROM ("
                          + " UNION ALL ".join(bins) + ") GROUP BY dataset, feature, bin")
    fix = lambda c: f"(CASE WHEN coalesce({c}, 0) = 0 THEN CAST('0.0001' AS DOUBLE) ELSE {c} END)"
    out[f"psi_{e}_{a}"] = (f"SELECT coalesce(x.feature, y.feature) AS feature, sum(({fix('y.share')} - {fix('x.share')}) * ln({fix('y.share')} / {fix('x.share')})) AS psi "
                           f"FROM (SELECT * FROM sh_{e}_{a} WHERE dataset = '{e}') x FULL JOIN (SELECT * FROM sh_{e}_{a} WHERE dataset = '{a}') y "
                           "ON x.feature = y.feature AND x.bin = y.bin GROUP BY 1")
    return out


def _part(spark, sf, name):
    return X.labelled(spark, sf).where(F.col("dataset") == name)


@query("a17_psi_numeric", sql(f"SELECT feature, {r('psi')} AS psi FROM psi_train_oot2", "labelled", **_binned("train", "oot2", NUMERIC, [])))
def a17(spark, sf):
    return rounded(D.psi(_part(spark, sf, "train"), _part(spark, sf, "oot2"), NUMERIC, exact=True))


@query("a18_psi_categorical", sql(f"SELECT feature, {r('psi')} AS psi FROM psi_train_oot2", "labelled", **_binned("train", "oot2", [], CATEGORICAL)))
def a18(spark, sf):
    return rounded(D.psi(_part(spark, sf, "train"), _part(spark, sf, "oot2"), CATEGORICAL))


_ALL = {}
for _e, _a in (("train", "oot1"), ("train", "oot2"), ("oot1", "oot2")):
    _ALL |= _binned(_e, _a, NUMERIC, CATEGORICAL)
_ALL["pairs"] = " UNION ALL ".join(f"SELECT feature, psi, '{e}_vs_{a}' AS comparison FROM psi_{e}_{a}" for e, a in (("train", "oot1"), ("train", "oot2"), ("oot1", "oot2")))
_ALL["best"] = ("SELECT feature, max(psi) AS m, CASE WHEN max(psi) < 0.1 THEN 'stable' WHEN max(psi) < 0.2 THEN 'moderately_stable' "
                "WHEN max(psi) < 0.25 THEN 'unstable' ELSE 'very_unstable' END AS stability_status FROM pairs GROUP BY feature")


def _pairs(spark, sf):
    return D.psi_pairs({d: _part(spark, sf, d) for d in DATASETS}, NUMERIC + CATEGORICAL, exact=True)


@query("a19_psi_pairs", sql(f"SELECT feature, comparison, {r('psi')} AS psi FROM pairs", "labelled", **_ALL))
def a19(spark, sf):
    return rounded(_pairs(spark, sf))


@query("a19_stability", sql(f"""SELECT feature, {r('m')} AS max_psi, stability_status, CASE stability_status WHEN 'stable' THEN 'none' WHEN 'moderately_stable' THEN 'minimal'
  WHEN 'unstable' THEN 'moderate' ELSE 'significant' END AS distribution_shift FROM best""", "labelled", **_ALL))
def a19_status(spark, sf):
    return rounded(D.stability(_pairs(spark, sf)))


@query("a19_stability_summary", sql(f"""SELECT {r('avg(psi)')} AS average_psi, {r('max(psi)')} AS maximum_psi, (SELECT count(*) FROM best) AS total_features,
  (SELECT count(*) FROM best WHERE stability_status = 'stable') AS stable_features,
  (SELECT count(*) FROM best WHERE stability_status IN ('unstable', 'very_unstable')) AS unstable_features,
  CASE WHEN avg(psi) < 0.1 THEN 'stable' WHEN avg(psi) < 0.2 THEN 'moderately_stable' ELSE 'unstable' END AS overall_stability FROM pairs""", "labelled", **_ALL))
def a19_summary(spark, sf):
    return rounded(D.stability_summary(_pairs(spark, sf)))


# one profile row per dataset and feature for the comparisons
PROFILED = ["price", "balance", "priority", "segment_gaps"]
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT dataset, '{c}' AS feature, count(*) AS n, count({c}) AS count, count(*) - count({c}) AS missing_count, "
    f"100 * (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS missing_percentage, count(DISTINCT {c}) AS unique_count, "
    + (f"avg({c}) AS mean, stddev_samp({c}) AS stddev, min({c}) AS min, max({c}) AS max, 'continuous' AS kind" if c in ("price", "balance")
       else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, 'categorical' AS kind")
    + " FROM labelled GROUP BY dataset" for c in PROFILED)


def _profile(spark, sf):
    return P.univariate_profile(X.labelled(spark, sf).select("dataset", *PROFILED), PROFILED, ["dataset"], exact=True)


def _uneven(spark, sf):
    """The latest dataset lacks one feature."""
    return _profile(spark, sf).where("NOT (dataset = 'oot2' AND feature = 'priority')")


@query("a26_feature_overlap", sql("""SELECT feature, string_agg(dataset, ',' ORDER BY dataset) AS datasets, count(*) AS dataset_count, count(*) = 3 AS is_common
  FROM prof WHERE NOT (dataset = 'oot2' AND feature = 'priority') GROUP BY feature""", "labelled", prof=PROFILE_SQL))
def a26(spark, sf):
    return K.feature_overlap(_uneven(spark, sf))


@query("a27_quality_comparison", sql(f"""SELECT p.*, d.duplicate_rows FROM (SELECT dataset, count(*) AS total_features, count(*) FILTER (missing_percentage > 0) AS features_with_missing,
  {r('avg(missing_percentage)')} AS avg_missing_percentage, sum(missing_count) AS total_missing_values FROM prof GROUP BY dataset) p JOIN
  (SELECT dataset, sum(c) - count(*) AS duplicate_rows FROM (SELECT dataset, priority, segment_gaps, nation, count(*) AS c FROM labelled GROUP BY ALL) GROUP BY dataset) d
  ON p.dataset = d.dataset""", "labelled", prof=PROFILE_SQL))
def a27(spark, sf):
    rows = X.labelled(spark, sf).select("dataset", "priority", "segment_gaps", "nation")
    return rounded(K.quality_comparison(_profile(spark, sf), rows))


_STATS = ["count", "missing_percentage", "unique_count", "mean", "stddev", "min", "max"]
_WIDE = ", ".join((r(f"max({s}) FILTER (dataset = '{d}')") if s not in ("count", "unique_count") else f"max({s}) FILTER (dataset = '{d}')") + f" AS {d}_{s}" for d in DATASETS for s in _STATS)


@query("j5_align_statistics", sql("SELECT feature, " + ", ".join(f"max(count) FILTER (dataset = '{d}') AS {d}_count" for d in DATASETS) + " FROM prof GROUP BY feature",
                                  "labelled", prof=PROFILE_SQL))
def j5(spark, sf):
    return K.statistics_side_by_side(_profile(spark, sf), DATASETS, ["count"])


@query("a28_statistics_comparison", sql(f"SELECT feature, {_WIDE} FROM prof WHERE feature <> 'priority' GROUP BY feature", "labelled", prof=PROFILE_SQL))
def a28(spark, sf):
    return rounded(K.statistics_side_by_side(_uneven(spark, sf), DATASETS))


# the price of the latest dataset depends on the target, so that correlations differ
SHIFTED = "CASE WHEN dataset = 'oot2' THEN price + 100000 * target ELSE price END"
CORR_SQL = " UNION ALL ".join(f"SELECT dataset, '{n}' AS feature, corr({e}, target) AS c FROM labelled GROUP BY dataset"
                              for n, e in (("price", SHIFTED), ("balance", "balance"), ("nation", "nation")))


def _corr(spark, sf):
    df = X.labelled(spark, sf).withColumn("price", F.expr(SHIFTED))
    return C.target_correlation(df, ["price", "balance", "nation"], "target", ["dataset"])


@query("a29_top_correlations", sql(f"""SELECT dataset, feature, {r('c')} AS correlation, row_number() OVER (PARTITION BY dataset ORDER BY abs(c) DESC, feature) AS rank FROM cc""",
                                   "labelled", cc=CORR_SQL))
def a29_top(spark, sf):
    return rounded(K.top_correlations(_corr(spark, sf)).select("dataset", "feature", "correlation", "rank"))


@query("a29_correlation_differences", sql(f"""SELECT feature, count(c) AS datasets, {r('min(c)')} AS min_correlation, {r('max(c)')} AS max_correlation,
  {r('max(c) - min(c)')} AS max_difference FROM cc GROUP BY feature HAVING max(c) - min(c) > 0.1""", "labelled", cc=CORR_SQL))
def a29(spark, sf):
    return rounded(K.correlation_differences(_corr(spark, sf)))


@query("a30_missing_drift", sql(f"""SELECT feature, count(*) AS datasets, {r('min(missing_percentage)')} AS min_missing, {r('max(missing_percentage)')} AS max_missing,
  {r('max(missing_percentage) - min(missing_percentage)')} AS difference FROM prof GROUP BY feature HAVING max(missing_percentage) - min(missing_percentage) > 5""",
                                "labelled", prof=PROFILE_SQL))
def a30(spark, sf):
    return rounded(K.missing_drift(_profile(spark, sf)))


RANK_SQL = f"""SELECT dataset, feature, kind, {r('measure')} AS measure, {r('cv')} AS cv, rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset, kind ORDER BY measure DESC, feature) AS rank FROM (
  SELECT dataset, feature, 'numeric' AS kind, stddev AS measure, CASE WHEN mean <> 0 THEN stddev / abs(mean) ELSE 0 END AS cv FROM prof WHERE kind = 'continuous' UNION ALL
  SELECT dataset, feature, 'categorical', CAST(unique_count AS DOUBLE), NULL FROM prof WHERE kind = 'categorical')) WHERE rank <= 5"""


@query("a31_variable_ranking", sql(RANK_SQL, "labelled", prof=PROFILE_SQL))
def a31(spark, sf):
    return rounded(K.variable_ranking(_profile(spark, sf)))


_REPORT = [
    "SELECT 'quality' AS section, dataset AS item, 'avg_missing_percentage' AS measure, avg(missing_percentage) AS value FROM prof GROUP BY dataset",
    "SELECT 'missing_drift', feature, 'difference', max(missing_percentage) - min(missing_percentage) FROM prof GROUP BY feature HAVING max(missing_percentage) - min(missing_percentage) > 5",
    "SELECT 'correlation_differences', feature, 'max_difference', max(c) - min(c) FROM cc GROUP BY feature HAVING max(c) - min(c) > 0.1",
] + [f"SELECT 'statistics', feature, '{d}_mean', max(mean) FILTER (dataset = '{d}') FROM prof GROUP BY feature" for d in DATASETS]


@query("a32_comparison_report", sql(f"SELECT section, item, measure, {r('value')} AS value FROM ({' UNION ALL '.join(_REPORT)})", "labelled", prof=PROFILE_SQL, cc=CORR_SQL))
def a32(spark, sf):
    from featurelens.operators.shared import pin_small
    report = K.comparison_report(pin_small(_profile(spark, sf))[0], pin_small(_corr(spark, sf))[0])
    long = K.report_long({k: report[k] for k in ("quality", "missing_drift", "correlation_differences", "statistics")})
    return rounded(long.where(F.col("measure").isin("avg_missing_percentage", "difference", "max_difference") | F.col("measure").endswith("_mean")))


def _daily_states(spark, sf):
    """The state of each day of events, stored and read back."""
    events = X.table(spark, sf, "events").withColumn("day", F.to_date("ts").cast("string"))
    path = fresh_path(spark, "states")
    ST.write_state(ST.take_state(events, ["value", "user_id"], ["event_type"], by=["day"]), path, "january")
    return ST.read_states(spark, path)


_STATE_SQL = ("SELECT {day}'{f}' AS feature, count(*) AS total_rows, count(*) FILTER ({f} IS NULL) AS missing_count, " + r("avg(CAST({n} AS DOUBLE))") + " AS mean, "
              + r("stddev_samp(CAST({n} AS DOUBLE))") + " AS stddev, min(CAST({n} AS DOUBLE)) AS min, max(CAST({n} AS DOUBLE)) AS max FROM events {group}")
_STATE_FEATURES = [("value", "value"), ("user_id", "user_id"), ("event_type", "NULL")]
_EXACT = ["feature", "total_rows", "missing_count", "mean", "stddev", "min", "max"]


@query("a24_profile_from_daily_states", " UNION ALL ".join(_STATE_SQL.format(day="", f=f, n=n, group="") for f, n in _STATE_FEATURES))
def a24_states(spark, sf):
    return rounded(ST.profile_of_state(ST.merge_states(_daily_states(spark, sf))).select(*_EXACT))


@query("a24_daily_profile", " UNION ALL ".join(_STATE_SQL.format(day="strftime(ts, '%Y-%m-%d') AS day, ", f=f, n=n, group="GROUP BY ALL") for f, n in _STATE_FEATURES))
def a24_daily(spark, sf):
    return rounded(ST.profile_of_state(_daily_states(spark, sf)).select("day", *_EXACT))


# with the quartiles and distinct counts of the sketches
@query("a24_profile_from_daily_states_result")
def a24_states_result(spark, sf):
    return ST.profile_of_state(ST.merge_states(_daily_states(spark, sf)))


def _half_month_psi(spark, sf):
    stored = _daily_states(spark, sf)
    early, late = (ST.merge_states(ST.ProfileState(stored.columns.where(c), stored.values.where(c))) for c in ("day <= '2024-01-15'", "day > '2024-01-15'"))
    return ST.psi_of_states(early, late)


@query("a18_psi_from_daily_states", "WITH c AS (SELECT ts >= TIMESTAMP '2024-01-16' AS late, coalesce(event_type, '(missing)') AS bin, count(*) AS n FROM events GROUP BY ALL), "
       "s AS (SELECT late, bin, n / CAST(sum(n) OVER (PARTITION BY late) AS DOUBLE) AS share FROM c), "
       "p AS (SELECT coalesce(a.share, 0.0001) AS e, coalesce(b.share, 0.0001) AS a FROM (FROM s WHERE NOT late) a FULL JOIN (FROM s WHERE late) b ON a.bin = b.bin) "
       f"SELECT 'event_type' AS feature, {r('sum((a - e) * ln(a / e))', 9)} AS psi FROM p")
def a18_states(spark, sf):
    return rounded(_half_month_psi(spark, sf).where("feature = 'event_type'"), 9)


@query("a17_psi_from_daily_states_result")
def a17_states_result(spark, sf):
    return _half_month_psi(spark, sf)
