"""Pieces shared by the document operators."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.operators.shared import ensure_checkpoint_dir

SPACE = rb"[\x20\x09-\x0d]"
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20

_gap = re.compile(SPACE)


def pack(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``_row``, so that no column of the input can clash with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of the documents whose labels nothing may learn from; a null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits naming a document by id and text; never null. Equal rows share it."""
    return [F.xxhash64(doc_id, text).alias("_k1"), F.xxhash64(text, F.lit("key"), doc_id).alias("_k2")]


def pieces(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes, cut at white space, so that long texts are never split into words at once."""
    start = 0
    while len(text) - start > size:
        found = _gap.search(text, start + size)
        if not found:
            break
        yield text[start:found.start()]
        start = found.start()
    yield text[start:] if start else text


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Prefix sums (own row included) of the columns ``sums`` maps to, in a total ``order``, without one task that sees every row.

    The rows are dealt by range, summed within each range, and shifted by the totals of the ranges before.
    """
    placed = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = placed.select("*", *[F.sum(c).over(inside).alias(f"_i_{n}") for n, c in sums.items()]).join(before, "_part")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"_i_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def bounded_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """At most ``n`` rows of each value of ``group``, those with the smallest of the hashes ``order``; null groups take no part.

    The groups are classes, counted first; a hash bound then leaves about twice ``n`` rows of each, which are ranked. So neither
    a frequent class nor a large number of partitions brings many rows together.
    """
    rows = rows.where(F.col(group).isNotNull())
    near = F.lit(False)
    for r in rows.groupBy(group).count().collect():
        share = min(1.0, (2 * n + 50) / r["count"])
        near = near | ((F.col(group) == F.lit(r[group])) & (F.col(order) <= F.lit(int(min(share * 2.0 ** 64 - 2.0 ** 63, 2.0 ** 63 - 1025)) if share < 1 else 2 ** 63 - 1)))
    return rows.where(near).withColumn("_rank", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("_rank") <= n).drop("_rank")
