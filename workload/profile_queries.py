"""Profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from featurelens.operators import correlate as C, profile as P
from workload import fixtures as X
from workload.fixtures import sql
from workload.registry import query, r, rounded

GAP_COLUMNS = ["num", "cat", "txt", "const", "mostly_null", "customer", "order_date_text", "flag"]
MISSING_SQL = {
    "num": "num IS NULL OR isnan(num)", "cat": "cat IS NULL OR trim(cat) = ''", "txt": "txt IS NULL OR trim(txt) = ''", "const": "const IS NULL",
    "mostly_null": "mostly_null IS NULL", "customer": "customer IS NULL OR trim(customer) = ''",
    "order_date_text": "order_date_text IS NULL OR trim(order_date_text) = ''", "flag": "flag IS NULL",
}
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


def per_column(columns, item: str) -> str:
    return " UNION ALL ".join(item.replace("{c}", c) for c in columns)


def missing_union(columns, body: str) -> str:
    return " UNION ALL ".join(body.format(c=c, miss=f"({MISSING_SQL[c]})") for c in columns)


@query("a1_missing_counts", sql(missing_union(
    GAP_COLUMNS, "SELECT '{c}' AS feature, count(*) FILTER ({miss}) AS missing_count, count(*) AS total_rows, "
    + r("count(*) FILTER ({miss}) / CAST(count(*) AS DOUBLE)") + " AS missing_fraction FROM gaps"), "gaps"))
def a1(spark, sf):
    return rounded(P.missing_counts(X.gaps(spark, sf), GAP_COLUMNS))


# the approximate count stays within five times its stated error of the exact one
@query("a2_categorical_cardinality", sql(missing_union(
    ["cat", "txt", "customer"], "SELECT '{c}' AS feature, true AS close, count(*) FILTER ({miss}) AS missing_count, count(*) AS total_count, "
    + r("100 * count(*) FILTER ({miss}) / CAST(count(*) AS DOUBLE)") + " AS missing_percentage FROM gaps"), "gaps"))
def a2(spark, sf):
    g = X.gaps(spark, sf)
    exact = P.exact_cardinality(g, ["cat", "txt", "customer"]).select("feature", F.col("unique_count").alias("exact"))
    out = P.categorical_cardinality(g, ["cat", "txt", "customer"]).join(exact, "feature")
    return rounded(out.select("feature", (F.abs(F.col("unique_count") - F.col("exact")) <= 1 + 0.05 * F.col("exact")).alias("close"),
                              "missing_count", "total_count", "missing_percentage"))


@query("a3_exact_cardinality", sql(missing_union(
    ["cat", "txt", "customer", "order_date_text"],
    "SELECT '{c}' AS feature, count(DISTINCT {c}) FILTER (NOT ({miss})) AS unique_count, count(*) FILTER ({miss}) AS missing_count, "
    "count(*) AS total_count, " + r("100 * count(*) FILTER ({miss}) / CAST(count(*) AS DOUBLE)") + " AS missing_percentage FROM gaps"), "gaps"))
def a3(spark, sf):
    return rounded(P.exact_cardinality(X.gaps(spark, sf), ["cat", "txt", "customer", "order_date_text"]))


def univariate_sql(columns, source: str, clean: str = "{c}") -> str:
    v = clean
    return per_column(columns, (
        f"SELECT '{{c}}' AS feature, count({v}) AS count, {r(f'avg({v})')} AS mean, {r(f'stddev_samp({v})')} AS stddev, "
        f"{r(f'min({v})')} AS min, {r(f'max({v})')} AS max, {r(f'quantile_cont({v}, 0.25)')} AS q25, "
        f"{r(f'quantile_cont({v}, 0.5)')} AS median, {r(f'quantile_cont({v}, 0.75)')} AS q75 FROM {source}"))


@query("a4_numeric_univariate", univariate_sql(LINE_NUMBERS, "lineitem"))
def a4(spark, sf):
    return rounded(P.numeric_univariate(X.table(spark, sf, "lineitem"), LINE_NUMBERS, exact=True))


@query("a4_numeric_univariate_sketch")
def a4_sketch(spark, sf):
    return rounded(P.numeric_univariate(X.table(spark, sf, "lineitem"), LINE_NUMBERS))


TOP_SQL = """SELECT feature, value, count, rank, non_null_count FROM (
  SELECT feature, value, count(*) AS count, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS rank,
         sum(count(*)) OVER (PARTITION BY feature) AS non_null_count
  FROM long GROUP BY feature, value) WHERE rank <= 10"""


def long_text(columns, source: str = "gaps") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM {source} WHERE trim(CAST({c} AS VARCHAR)) <> ''" for c in columns)


@query("a5_categorical_univariate", sql(TOP_SQL, "gaps", long=long_text(["cat", "txt", "customer"])))
def a5(spark, sf):
    return P.categorical_univariate(X.gaps(spark, sf), ["cat", "txt", "customer"])


LINE_ALL = ["l_quantity", "l_discount", "l_linenumber", "l_returnflag", "l_shipdate"]


@query("a6_feature_kind", """SELECT feature, unique_count, CASE WHEN numeric AND unique_count BETWEEN 1 AND 10 THEN 'discrete'
  WHEN numeric THEN 'continuous' ELSE 'categorical' END AS feature_type FROM (
  SELECT 'l_quantity' AS feature, count(DISTINCT l_quantity) AS unique_count, true AS numeric FROM lineitem UNION ALL
  SELECT 'l_discount', count(DISTINCT l_discount), true FROM lineitem UNION ALL
  SELECT 'l_linenumber', count(DISTINCT l_linenumber), true FROM lineitem UNION ALL
  SELECT 'l_returnflag', count(DISTINCT l_returnflag), false FROM lineitem UNION ALL
  SELECT 'l_shipdate', count(DISTINCT l_shipdate), false FROM lineitem)""")
def a6(spark, sf):
    p = P.univariate_profile(X.table(spark, sf, "lineitem"), LINE_ALL, exact=True)
    return p.select("feature", "unique_count", "feature_type")


QUALITY = ["key", "num", "cat", "const", "mostly_null", "customer"]
QUALITY_BASE = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) FILTER (NOT ({MISSING_SQL.get(c, c + ' IS NULL')})) AS u, "
    f"count(*) FILTER ({MISSING_SQL.get(c, c + ' IS NULL')}) * 100 / CAST(count(*) AS DOUBLE) AS m, count(*) AS n, "
    + (f"stddev_samp({c}) FILTER (NOT ({MISSING_SQL.get(c, c + ' IS NULL')}))" if c in ("key", "num", "const", "mostly_null") else "CAST(NULL AS DOUBLE)")
    + " AS s FROM gaps" for c in QUALITY)
WARN_SQL = """SELECT feature, m, u, list_filter([CASE WHEN m > 50 THEN 'high_missing_values:high' WHEN m > 20 THEN 'high_missing_values:moderate' END,
  CASE WHEN u = 1 THEN 'constant_feature:critical' END, CASE WHEN u / CAST(n AS DOUBLE) > 0.95 AND u > 100 THEN 'high_cardinality:moderate' END,
  CASE WHEN s < 0.01 THEN 'low_variance:moderate' END], lambda x: x IS NOT NULL) AS w FROM base"""
GRADE_SQL = """SELECT feature, m, u, array_to_string(w, ',') AS warnings, CASE WHEN len(w) = 0 THEN 'A'
  WHEN list_contains(w, 'constant_feature:critical') THEN 'F' WHEN list_contains(w, 'high_missing_values:high') THEN 'C' ELSE 'B' END AS grade FROM warned"""


@query("a7_quality_grades", sql(f"SELECT feature, u AS unique_count, {r('m')} AS missing_percentage, warnings, grade FROM graded", "gaps",
                                base=QUALITY_BASE, warned=WARN_SQL, graded=GRADE_SQL))
def a7(spark, sf):
    p = P.univariate_profile(X.gaps(spark, sf), QUALITY, exact=True)
    return rounded(p.select("feature", "unique_count", "missing_percentage", F.array_join("warnings", ",").alias("warnings"), "grade"))


@query("a8_quality_score", sql(
    f"""SELECT features, {r('s')} AS overall_score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS overall_grade
    FROM (SELECT count(*) AS features, avg(CASE grade WHEN 'A' THEN 95 WHEN 'B' THEN 85 WHEN 'C' THEN 75 WHEN 'D' THEN 65 ELSE 50 END) AS s FROM graded)""",
    "gaps", base=QUALITY_BASE, warned=WARN_SQL, graded=GRADE_SQL))
def a8(spark, sf):
    return rounded(P.quality_score(P.univariate_profile(X.gaps(spark, sf), QUALITY, exact=True)))


@query("a9_class_distribution", f"""WITH c AS (SELECT o_orderstatus, count(*) AS count FROM orders GROUP BY 1)
  SELECT o_orderstatus, count, {r('count / CAST(sum(count) OVER () AS DOUBLE)')} AS share,
  first_value(o_orderstatus) OVER (ORDER BY count, o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS minority_class,
  last_value(o_orderstatus) OVER (ORDER BY count, o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS majority_class,
  min(count) OVER () AS minority_count, max(count) OVER () AS majority_count, count(*) OVER () AS num_classes FROM c""")
def a9(spark, sf):
    return rounded(P.class_distribution(X.table(spark, sf, "orders"), "o_orderstatus"))


@query("a10_imbalance", sql(f"""SELECT bool_or(s < 0.05) AS is_imbalanced, count(*) FILTER (s < 0.05) AS imbalanced_classes, {r('min(s)')} AS minority_share
  FROM (SELECT count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS s FROM rare GROUP BY target)""", "rare"))
def a10(spark, sf):
    return rounded(P.detect_imbalance(P.class_distribution(X.rare(spark, sf), "target")))


@query("a11_problem_type", """SELECT 'o_orderstatus' AS target, count(DISTINCT o_orderstatus) AS num_classes,
  CASE WHEN count(DISTINCT o_orderstatus) > 2 THEN 'multiclass' ELSE 'binary' END AS problem_type, true AS needs_encoding FROM orders""")
def a11(spark, sf):
    return P.detect_problem_type(X.table(spark, sf, "orders"), "o_orderstatus")


def bucket_sql(columns, value: str, n: int = 5, source: str = "labelled") -> tuple[str, str]:
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN CAST({c} AS VARCHAR) END AS value, {value} AS t FROM {source}" for c in columns)
    top = (f"SELECT feature, value FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS k FROM long "
           f"WHERE value IS NOT NULL GROUP BY feature, value) WHERE k <= {n}")
    return long, top


BINNED = ("SELECT l.feature, CASE WHEN l.value IS NULL THEN '(missing)' WHEN t.value IS NOT NULL THEN l.value ELSE 'OTHER_CATEGORIES' END AS bin, l.t "
          "FROM long l LEFT JOIN top t ON l.feature = t.feature AND l.value = t.value")
BY_CLASS = f"""SELECT feature, bin, target_value, count, {r('100 * count / CAST(sum(count) OVER (PARTITION BY feature, bin) AS DOUBLE)')} AS percentage
  FROM (SELECT feature, bin, CAST(t AS VARCHAR) AS target_value, count(*) AS count FROM binned GROUP BY ALL)"""
BY_VALUE = f"SELECT feature, bin, count(t) AS count, {r('avg(t)')} AS target_mean, {r('stddev_samp(t)', 4)} AS target_std FROM binned GROUP BY feature, bin"
CATS = ["priority", "segment_gaps", "nation"]
_long, _top = bucket_sql(CATS, "target")


@query("a12_categorical_by_class", sql(BY_CLASS, "labelled", long=_long, top=_top, binned=BINNED))
def a12(spark, sf):
    return rounded(P.categorical_by_class(X.labelled(spark, sf), CATS, "target"))


_long_v, _top_v = bucket_sql(CATS, "price")


@query("a13_categorical_by_value", sql(BY_VALUE, "labelled", long=_long_v, top=_top_v, binned=BINNED))
def a13(spark, sf):
    return rounded(P.categorical_by_value(X.labelled(spark, sf), CATS, "price"), target_std=4)


def quartile_sql(columns, value: str, source: str) -> tuple[str, str]:
    clean = lambda c: f"CASE WHEN NOT isnan(CAST({c} AS DOUBLE)) THEN CAST({c} AS DOUBLE) END"
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {clean(c)} AS value, {value} AS t FROM {source}" for c in columns)
    edges = ("SELECT feature, min(value) AS mn, quantile_cont(value, 0.25) AS q1, (quantile_cont(value, 0.25) + quantile_cont(value, 0.75)) / 2 AS mid, "
             "quantile_cont(value, 0.75) AS q3, max(value) AS mx FROM long GROUP BY feature")
    return long, edges


QBINNED = ("SELECT l.feature, CASE WHEN value IS NULL THEN '(missing)' WHEN value <= q1 THEN 'Bin_1_Low' WHEN value <= mid THEN 'Bin_2_Lower_Mid' "
           "WHEN value <= q3 THEN 'Bin_3_Upper_Mid' WHEN value <= mx THEN 'Bin_4_High' ELSE 'Bin_5_Very_High' END AS bin, t FROM long l JOIN edges e ON l.feature = e.feature")
_ql, _qe = quartile_sql(["num", "const", "mostly_null"], "flag", "gaps")


@query("a14_numeric_by_class", sql(BY_CLASS, "gaps", long=_ql, edges=_qe, binned=QBINNED))
def a14(spark, sf):
    return rounded(P.numeric_by_class(X.gaps(spark, sf), ["num", "const", "mostly_null"], "flag", exact=True))


_pl, _pe = quartile_sql(["quantity", "discount", "tax"], "target", "priced")


@query("a15_numeric_by_value", sql(BY_VALUE, "priced", long=_pl, edges=_pe, binned=QBINNED))
def a15(spark, sf):
    return rounded(P.numeric_by_value(X.priced(spark, sf), ["quantity", "discount", "tax"], "target", exact=True), target_std=4)


_bc_long, _bc_top = bucket_sql(["flag", "line"], "target", source="priced")
_bn_long, _bn_edges = quartile_sql(["quantity", "discount"], "target", "priced")
_CAT_PART = BY_VALUE.replace("FROM binned", "FROM cbinned")
_NUM_PART = BY_VALUE.replace("FROM binned", "FROM nbinned")


@query("a16_bivariate", sql(
    f"SELECT *, 'categorical' AS feature_type FROM ({_CAT_PART}) UNION ALL SELECT *, 'numerical' FROM ({_NUM_PART})", "priced",
    long=_bc_long, top=_bc_top, cbinned=BINNED, nlong=_bn_long, nedges=_bn_edges.replace("FROM long", "FROM nlong"),
    nbinned=QBINNED.replace("FROM long l JOIN edges e", "FROM nlong l JOIN nedges e")))
def a16(spark, sf):
    # ``line`` has seven values and is not declared: it is routed to the categories
    return rounded(P.bivariate_profile(X.priced(spark, sf), ["flag", "line", "quantity", "discount"], "target", "regression", exact=True,
                                       numeric=["quantity", "discount"]), target_std=4)


CORR = ["quantity", "discount", "tax", "line", "target", "prediction"]
MATRIX_SQL = " UNION ALL ".join(f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS correlation FROM priced" for a in CORR for b in CORR)


@query("a20_correlation_matrix", sql(f"SELECT feature1, feature2, {r('correlation')} AS correlation FROM m", "priced", m=MATRIX_SQL))
def a20(spark, sf):
    return rounded(C.correlation_matrix(X.priced(spark, sf), CORR))


STRENGTH_SQL = ("CASE WHEN {c} IS NULL THEN 'undefined' WHEN abs({c}) >= 0.8 THEN 'very_strong' WHEN abs({c}) >= 0.6 THEN 'strong' "
                "WHEN abs({c}) >= 0.4 THEN 'moderate' WHEN abs({c}) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength, "
                "CASE WHEN {c} > 0 THEN 'positive' WHEN {c} < 0 THEN 'negative' ELSE 'none' END AS relationship_type").replace("{c}", "correlation")


@query("a21_target_ranking", sql(
    f"SELECT feature1 AS feature, {r('correlation')} AS correlation, {r('abs(correlation)')} AS abs_correlation, {STRENGTH_SQL} FROM m "
    "WHERE feature2 = 'target' AND feature1 <> 'target'", "priced", m=MATRIX_SQL))
def a21(spark, sf):
    return rounded(C.target_ranking(C.correlation_matrix(X.priced(spark, sf), CORR), "target"))


@query("a22_collinear_pairs", sql(
    f"SELECT feature1, feature2, {r('correlation')} AS correlation, {r('abs(correlation)')} AS abs_correlation, true AS multicollinearity_warning FROM m "
    "WHERE feature1 < feature2 AND feature1 <> 'target' AND feature2 <> 'target' AND abs(correlation) > 0.7", "priced", m=MATRIX_SQL))
def a22(spark, sf):
    pairs = C.collinear_pairs(C.correlation_matrix(X.priced(spark, sf), CORR), [c for c in CORR if c != "target"])
    flag = C.collinearity_summary(pairs).first()["multicollinearity_warning"]
    return rounded(pairs.withColumn("multicollinearity_warning", F.lit(flag)))


@query("a23_target_correlation", sql(
    f"SELECT dataset, feature, {r('correlation')} AS correlation, {r('abs(correlation)')} AS abs_correlation, {STRENGTH_SQL} FROM ("
    + " UNION ALL ".join(f"SELECT dataset, '{c}' AS feature, corr({c}, target) AS correlation FROM priced GROUP BY dataset" for c in ["quantity", "discount", "tax", "line"])
    + ")", "priced"))
def a23(spark, sf):
    return rounded(C.target_correlation(X.priced(spark, sf), ["quantity", "discount", "tax", "line"], "target", ["dataset"]))


# The three tables of a full profile as one long table
FULL = ["quantity", "discount", "flag"]


def _full_sql(group: bool) -> str:
    d = "dataset" if group else "'all' AS dataset"
    g = "GROUP BY dataset" if group else ""
    parts = []
    for c in FULL:
        num = c != "flag"
        v = c if num else "NULL"
        item = lambda name, e: f"SELECT {d}, 'univariate' AS part, '{c}' AS feature, '' AS bin, '{name}' AS measure, CAST({e} AS DOUBLE) AS value FROM priced {g}"
        parts += [item("unique_count", f"count(DISTINCT {c})"), item("missing_count", f"count(*) - count({c})")]
        if num:
            parts += [item("mean", f"avg({v})"), item("median", f"quantile_cont({v}, 0.5)")]
            parts.append(f"SELECT {d}, 'correlation', '{c}', '', 'correlation', corr({c}, target) FROM priced {g}")
    return " UNION ALL ".join(parts)


def _full_frame(tables, dataset: bool):
    d = F.col("dataset") if dataset else F.lit("all")
    u = tables["univariate"].select(d.alias("dataset"), F.lit("univariate").alias("part"), "feature", F.lit("").alias("bin"),
                                    *[F.col(c).cast("double").alias(c) for c in ("unique_count", "missing_count", "mean", "median")])
    u = u.unpivot(["dataset", "part", "feature", "bin"], ["unique_count", "missing_count", "mean", "median"], "measure", "value").where("value IS NOT NULL")
    c = tables["correlation"].select(d.alias("dataset"), F.lit("correlation").alias("part"), "feature", F.lit("").alias("bin"),
                                     F.lit("correlation").alias("measure"), F.col("correlation").alias("value"))
    b = tables["bivariate"].select(d.alias("dataset"), F.lit("bivariate").alias("part"), "feature", "bin",
                                   F.col("count").cast("double").alias("count"), F.col("target_mean").alias("target_mean"))
    b = b.unpivot(["dataset", "part", "feature", "bin"], ["count", "target_mean"], "measure", "value")
    return rounded(u.unionByName(b).unionByName(c))


_BIV = ("SELECT {d} AS dataset, 'bivariate' AS part, feature, bin, 'count' AS measure, CAST(count(t) AS DOUBLE) AS value FROM {b} GROUP BY ALL UNION ALL "
        "SELECT {d} AS dataset, 'bivariate', feature, bin, 'target_mean', avg(t) FROM {b} GROUP BY ALL")


def _full_text(group: bool) -> str:
    g = "dataset" if group else "'all'"
    value = "target, dataset" if group else "target"
    longc = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, target AS t, {g} AS dataset FROM priced" for c in ["flag", "discount"]).replace(", discount AS value", ", CAST(discount AS VARCHAR) AS value")
    top = ("SELECT dataset, feature, value FROM (SELECT dataset, feature, value, row_number() OVER (PARTITION BY dataset, feature ORDER BY count(*) DESC, value) AS k "
           "FROM clong GROUP BY dataset, feature, value) WHERE k <= 5")
    cbin = ("SELECT l.dataset, l.feature, CASE WHEN t.value IS NOT NULL THEN l.value ELSE 'OTHER_CATEGORIES' END AS bin, l.t FROM clong l "
            "LEFT JOIN ctop t ON l.dataset = t.dataset AND l.feature = t.feature AND l.value = t.value")
    longn = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, target AS t, {g} AS dataset FROM priced" for c in ["quantity"])
    edges = ("SELECT dataset, feature, quantile_cont(value, 0.25) AS q1, (quantile_cont(value, 0.25) + quantile_cont(value, 0.75)) / 2 AS mid, "
             "quantile_cont(value, 0.75) AS q3, max(value) AS mx FROM nlong GROUP BY dataset, feature")
    nbin = ("SELECT l.dataset, l.feature, CASE WHEN value <= q1 THEN 'Bin_1_Low' WHEN value <= mid THEN 'Bin_2_Lower_Mid' WHEN value <= q3 THEN 'Bin_3_Upper_Mid' "
            "ELSE 'Bin_4_High' END AS bin, t FROM nlong l JOIN nedges e ON l.feature = e.feature AND l.dataset = e.dataset")
    body = (f"SELECT dataset, part, feature, bin, measure, {r('value')} AS value FROM ({_full_sql(group)} UNION ALL "
            + _BIV.format(d="dataset", b="cbin") + " UNION ALL " + _BIV.format(d="dataset", b="nbin") + ")")
    return sql(body, "priced", clong=longc, ctop=top, cbin=cbin, nlong=longn, nedges=edges, nbin=nbin)


@query("a24_full_profile", _full_text(False))
def a24(spark, sf):
    return _full_frame(P.full_profile(X.priced(spark, sf), FULL, "target", "regression", exact=True), False)


@query("a25_profile_datasets", _full_text(True))
def a25(spark, sf):
    p = X.priced(spark, sf)
    tagged = P.tag_datasets({d: p.where(F.col("dataset") == d).drop("dataset") for d in ("train", "oot1")})
    return _full_frame(P.full_profile(tagged, FULL, "target", "regression", ["dataset"], exact=True), True)


SIZE_TYPES = {"o_orderkey": ("long", 8), "o_custkey": ("long", 8), "o_orderstatus": ("string", None), "o_totalprice": ("double", 8),
              "o_orderdate": ("timestamp_ntz", 16), "o_orderpriority": ("string", None)}
SIZE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{t}' AS data_type, " + (f"(avg(length({c})) + max(length({c}))) / 2" if b is None else f"CAST({b} AS DOUBLE)")
    + " AS estimated_bytes, count(*) AS row_count FROM orders" for c, (t, b) in SIZE_TYPES.items())


@query("a33_size_profile", f"SELECT feature, data_type, {r('estimated_bytes')} AS estimated_bytes, row_count FROM ({SIZE_SQL})")
def a33(spark, sf):
    return rounded(P.size_profile(X.table(spark, sf, "orders")))


@query("a33_table_size", f"""SELECT row_count, column_count, {r('mb')} AS total_size_mb, CASE WHEN mb < 100 THEN 'small' WHEN mb < 1000 THEN 'medium'
  WHEN mb < 10000 THEN 'large' ELSE 'huge' END AS category FROM (SELECT max(row_count) AS row_count, count(*) AS column_count,
  sum(estimated_bytes) * max(row_count) / (1024 * 1024) AS mb FROM ({SIZE_SQL}))""")
def a33_table(spark, sf):
    return rounded(P.table_size(X.table(spark, sf, "orders")))


@query("a34_complexity_score", f"""SELECT 2 AS string_columns, h AS high_cardinality, 4 AS data_types, {r('least(1.0, 0.2 + 0.4 + 0.2 * h)')} AS complexity_score
  FROM (SELECT (CASE WHEN count(DISTINCT o_orderstatus) > 1000 THEN 1 ELSE 0 END) + (CASE WHEN count(DISTINCT o_orderpriority) > 1000 THEN 1 ELSE 0 END) AS h FROM orders)""")
def a34(spark, sf):
    return rounded(P.complexity_score(X.table(spark, sf, "orders"), exact=True))


@query("a35_dataset_size_class", """SELECT count(*) AS row_count, CASE WHEN count(*) < 10000 THEN 'small' WHEN count(*) < 100000 THEN 'medium'
  ELSE 'large' END AS size_class FROM lineitem""")
def a35(spark, sf):
    return P.dataset_size_class(X.table(spark, sf, "lineitem"))
