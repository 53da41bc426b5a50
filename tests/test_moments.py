"""Co-moments against numpy: gaps, blocks, large offsets, constants, empty tables; one scan in the plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurelens.operators import moments as M
from featurelens.operators.correlate import correlation_matrix
from featurelens.operators.select import statistics_table


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 7)) @ rng.normal(size=(7, 7))
    x[:, 2] += 1e9                                    # far from zero
    x[:, 3] = 4.2                                     # constant
    x[rng.random(x.shape) < 0.15] = np.nan
    x[:400, 5] = np.nan                               # first seen late
    x[:, 6] = np.nan                                  # never seen
    return x


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(data)]
    return spark.createDataFrame(rows, ", ".join(f"x{i} double" for i in range(7))).repartition(5)


def pair_by_hand(data, i, j):
    both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, j])
    a, b = data[both, i], data[both, j]
    if not len(a):
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0
    da, db = a - a.mean(), b - b.mean()
    return len(a), a.mean(), b.mean(), (da * da).sum(), (db * db).sum(), (da * db).sum()


@pytest.mark.parametrize("width", [2, 3, 100])
def test_pairs(frame, data, width):
    names = frame.columns
    got = {(r["feature1"], r["feature2"]): tuple(r)[3:] for r in M.co_moments(frame, names, width=width).collect()}
    assert len(got) == 49
    for i in range(7):
        for j in range(7):
            assert got[names[i], names[j]] == pytest.approx(pair_by_hand(data, i, j), rel=1e-6, abs=1e-6)


def test_target_and_own(frame, data):
    rows = M.co_moments(frame, frame.columns, ["x1"], width=3).collect()
    own = {r["feature1"]: r for r in rows if r["own"]}
    assert len(rows) == 14 and len(own) == 7
    for i in range(7):
        n, mean, _, m11, _, _ = pair_by_hand(data, i, i)
        assert (own[f"x{i}"]["n"], own[f"x{i}"]["mean1"], own[f"x{i}"]["m11"]) == pytest.approx((n, mean, m11), rel=1e-6, abs=1e-6)


def test_statistics(frame, data):
    got = {r["feature"]: r for r in statistics_table(frame, frame.columns, "x0").collect()}
    for i in range(1, 6):
        both = ~np.isnan(data[:, i]) & ~np.isnan(data[:, 0])
        assert got[f"x{i}"]["variance"] == pytest.approx(np.nanvar(data[:, i], ddof=1), rel=1e-6, abs=1e-9)
        if i == 3:
            assert got["x3"]["variance"] == 0.0 and got["x3"]["correlation"] is None
        else:
            assert got[f"x{i}"]["correlation"] == pytest.approx(np.corrcoef(data[both, i], data[both, 0])[0, 1], abs=1e-6)
    assert got["x6"]["variance"] is None and got["x6"]["correlation"] is None


def test_one_scan(spark, tmp_path):
    spark.range(100).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(60)]).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    plan = statistics_table(df, df.columns, "c0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_empty_and_single(spark, frame):
    for df, n in ((frame.limit(0), 0), (frame.where("x0 is not null").limit(1), 1)):
        rows = M.co_moments(df, ["x0", "x1"]).collect()
        assert len(rows) == 4 and {r["n"] for r in rows} <= {0.0, float(n)}
    assert {r["correlation"] for r in correlation_matrix(frame.limit(0), ["x0", "x1"]).collect()} == {1.0, None}


def test_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) * [1, 10, 0.1, 5] + [0, 100, 3, -7]
    y = x @ [2.0, -0.5, 30.0, 0.0] + 11 + rng.normal(size=300) * 0.01
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], ["a", "b", "c", "d", "y"])
    got = M.least_squares(M.co_moments(df, ["a", "b", "c", "d", "y"]), ["a", "b", "c", "d"], "y")
    want = np.linalg.lstsq(np.column_stack([x, np.ones(300)]), y, rcond=None)[0]
    assert [got[k] for k in ("a", "b", "c", "d", "intercept")] == pytest.approx(list(want), rel=1e-5, abs=1e-5)
