"""Joins of density clustering stay off the driver, and the comparisons of few bytes keep their tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from featurelens.operators import dbscan as D, density as DG, neighbours as N
from featurelens.operators.joins import salted_join, spread_join


@pytest.mark.parametrize("join", [lambda a, b: salted_join(a, b, ["k"], spread=True), lambda a, b: spread_join(a, b, ["k"]),
                                  lambda a, b: salted_join(a, b, ["k"], "left", salt_over=0, spread=True)])
def test_row_sized_sides_are_not_broadcast(spark, join):
    a, b = spark.range(1000).select((F.col("id") % 10).alias("k"), "id"), spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    out = join(a, b)
    assert out.count() == 1000
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()


def test_chunk_pairs_keep_their_tasks(spark):
    rng = np.random.default_rng(3)
    pts = spark.createDataFrame([(list(map(float, v)),) for v in rng.uniform(0, 100, (400, 2))], "vec array<double>")
    cells = N.make_cells(pts, 8)

    def size(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(left)]})

    out = N.chunk_apply(cells, pts, pts, np.full(8, 1.0), size, "n bigint")
    assert out.agg(F.sum("n")).first()[0] == 400
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_links_of_single_core_points(spark):
    """A task hands on a forest of its links; linked core points keep one cluster, in both forms of the clustering."""
    rng = np.random.default_rng(5)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 30, (300, 2)))]
    df = spark.createDataFrame(rows, "key int, x double, y double")
    found = {r["key"]: (r["prediction"], r["core"]) for r in D.fit_dbscan(df, "key", ["x", "y"], 2.0, 4).collect()}
    xy = np.array([r[1:] for r in rows])
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(axis=2)) <= 2.0
    core = near.sum(axis=1) >= 4
    assert {k: c for k, (_, c) in found.items()} == dict(enumerate(core.tolist()))
    same = np.array([found[i][0] for i in range(300)])
    i, j = np.nonzero(near & core[:, None] & core[None])
    assert (same[i] == same[j]).all() and (same[core] >= 0).all()
    grid = DG.density_grid(df, "key", ["x", "y"], [2.0], [4]).collect()
    assert {r["key"]: (r["prediction"], r["core"]) for r in grid} == found
