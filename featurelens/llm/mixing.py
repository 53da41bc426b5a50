"""Operator 1: mix sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.llm.text import WORD, checkpointed, pack, running

WEIGHTS = (5, 2, 1)
MOST = 3


def _unit(*parts: Column) -> Column:
    """A multiple of 2**-20 in [0, 1): adding it to whole numbers rounds nothing."""
    return F.conv(F.substring(F.md5(F.concat(*parts).cast("binary")), 1, 5), 16, 10).cast("bigint") / F.lit(1048576.0)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` for ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn and share the total size. A target stops at ``most``
    times its source's size and the excess is shared by weight among the others. That is one common level: sources in
    order of capacity per weight are capped until the level of the rest is at most the capacity of the next one.
    """
    ranked = running(sizes.withColumn("_one", F.lit(1).cast("bigint")), [F.asc_nulls_last("source")], {"_at": "_one"})
    turn = F.element_at(F.array(*[F.lit(int(w)).cast("bigint") for w in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("_weight", turn).withColumn("_cap", F.col("source_size") * F.lit(most))
    weighed = weighed.withColumn("_room", F.col("_cap") / F.col("_weight"))
    level = running(weighed, [F.asc("_room"), F.asc_nulls_last("source")], {"_caps": "_cap", "_weights": "_weight"})
    total = level.agg(F.sum("source_size").alias("size"), F.sum("_weight").alias("weight")).first()
    level = level.withColumn("_level", (F.lit(total["size"]) - (F.col("_caps") - F.col("_cap"))) / (F.lit(total["weight"]) - (F.col("_weights") - F.col("_weight"))))
    common = level.where(F.col("_level") <= F.col("_room")).agg(F.min_by("_level", F.struct("_room", "_at")).alias("level")).first()["level"]
    return level.select(*[c for c in sizes.columns], F.least(F.col("_cap").cast("double"), F.col("_weight") * F.lit(common)).alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST, seed: str = "mix",
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Every row of ``docs`` as ``_row`` with ``size, source_size, target, copies``.

    A row's size is its number of words; its expected copies are target / source_size, the same for the whole source.
    Within a source the rows stand in an order that is free of the partitioning (size class, hash of the id; a null id counts
    as its text; then by hashes of text and row, so that only equal rows tie), expected copies are summed up along it, one offset per
    source is added, and a row is taken once for every whole number that its span of the sum crosses. Ordering by size class
    keeps the words taken near the target.

    The order is cut into groups (source, size class, first hash digits), numbered within a group and shifted by the
    counts of the groups before, so a source with most of the rows is spread over many tasks. A null or empty text has
    size 0 and is drawn like any other row. A null source is a source of its own. Repeated rows are separate rows. An
    empty table gives no rows. Other columns are carried along whatever their names.
    """
    rows = pack(docs)
    key = F.coalesce(F.col(f"_row.{id_col}").cast("string"), F.col(f"_row.{text_col}"), F.lit(""))
    source = F.col(f"_row.{source_col}")
    rows = rows.select("_row", F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("_source"), source.alias("source"),
                       F.coalesce(F.regexp_count(F.col(f"_row.{text_col}"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
                       F.md5(F.concat(F.lit(seed + ":"), key).cast("binary")).alias("_h"), F.md5(F.col(f"_row.{text_col}").cast("binary")).alias("_t"), F.xxhash64("_row").alias("_x"))
    bits = "length(bin(size))"
    rows = rows.withColumn("_class", F.expr(f"{bits} * 16 + shiftright(size, greatest({bits} - 4, 0))")).withColumn("_cell", F.substring("_h", 1, 2))
    group = ["_source", "_class", "_cell"]
    cells = checkpointed(rows.groupBy(*group).agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_s")))
    ahead = W.partitionBy("_source").orderBy("_class", "_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = cells.select(*group, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    targets = source_targets(cells.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_s").alias("source_size")), weights, most)
    offset = _unit(F.lit(seed), F.col("_source"))
    plan = starts.join(targets.drop("source"), "_source").withColumn("_offset", offset)
    numbered = rows.withColumn("_i", F.row_number().over(W.partitionBy(*group).orderBy("_h", "size", "_t", "_x")).cast("bigint")).join(plan, group)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("_before") + F.col("_i")
    copies = F.floor(F.col("_offset") + at * rate) - F.floor(F.col("_offset") + (at - 1) * rate)
    return numbered.select("_row", "size", "source_size", "target", copies.cast("bigint").alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken."""
    taken = mix(docs, **options)
    return taken.where(F.col("copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("_row.*")
