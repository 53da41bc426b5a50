"""Connected components by alternating stars, with lineage cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from featurelens.operators.joins import salted_join
from featurelens.operators.shared import ensure_checkpoint_dir


def _star(edges: DataFrame, large: bool, spread: bool) -> DataFrame:
    """Link the neighbours of every node to the smallest node around it."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = salted_join(pairs, low, ["u"], spread=spread)
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100, spread: bool = False) -> DataFrame:
    """``node, component`` (smallest node of the component) for ``nodes(node)`` and ``edges(u, v)``.

    With ``spread`` no side of a join goes through the driver.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    current = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    state = None
    for _ in range(max_rounds):
        big = _star(current, True, spread).checkpoint()
        current = _star(big, False, spread).checkpoint()
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == (seen["n"], seen["h"]):
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.join(found.hint("merge") if spread else found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
