"""Operator 6: line deduplication over overlapping windows of three lines. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from featurelens.llm.text import WORD, pack, row_key

LINES = 3
SALTS = 16          # tasks over which the places of a window are dealt; at most 32, a bit of an int each


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pack(docs)
    doc_id, text = F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}")
    return rows.select("_row", doc_id.alias("_id"), text.alias("_text"), *row_key(doc_id, text))


def _windows(rows: DataFrame) -> DataFrame:
    """``_h1, _h2, _id, _k1, _k2, _at``: one row for each window that holds a line with a letter, digit or sign."""
    lines = rows.where(F.contains("_text", F.lit("\n"))).select("_id", "_k1", "_k2", F.split("_text", "\n").alias("_lines"))
    lines = lines.where(F.size("_lines") >= LINES)

    def at(i: Column) -> Column:
        here = [F.get("_lines", i + k) for k in range(LINES)]
        return F.struct(i.cast("int").alias("at"), F.xxhash64(*here).alias("h1"), F.xxhash64(*reversed(here), F.lit(LINES)).alias("h2"),
                        F.concat(*here).rlike(WORD).alias("full"))

    found = F.transform(F.sequence(F.lit(0), F.size("_lines") - LINES), at)
    return lines.select("_id", "_k1", "_k2", F.explode(found).alias("_w")).where("_w.full").select(
        F.col("_w.h1").alias("_h1"), F.col("_w.h2").alias("_h2"), "_id", "_k1", "_k2", F.col("_w.at").alias("_at"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``_row`` with ``n_lines, n_removed, kept_text``.

    A text's lines are its parts between newlines. A window of three consecutive lines that stands at several places of the
    corpus stays at the first place, in the order of (id, null first; hash of the row; position); all lines that a later
    place covers go. Windows that overlap merge, so a long passage goes whole. Windows of blank lines (spaces, tabs, carriage returns) do not count, and a text
    of fewer than three lines has no window. A null text stays null with 0 lines. Rows that repeat both id and text
    are one document and get the same result. Other columns are carried along whatever their names.

    The first places come from a grouped minimum, combined before the shuffle; only windows with a second place are
    joined back. The places of a window are dealt over ``SALTS`` tasks by document; which of these hold some is kept as bits,
    so the first place is copied to no more tasks than the window has places, and no window brings all of them to one task.
    """
    rows = _named(docs, id_col, text_col)
    windows = _windows(rows).withColumn("_salt", F.pmod("_k1", F.lit(SALTS)).cast("int"))
    place = F.struct("_id", "_k1", "_k2", "_at")
    repeated = windows.groupBy("_h1", "_h2").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.bit_or(F.expr("shiftleft(1, _salt)")).alias("_salts")).where(
        ~F.col("_first").eqNullSafe(F.col("_last")))
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("_salts", i) == 1)
    later = windows.join(repeated.select("_h1", "_h2", "_first", F.explode(salts).alias("_salt")), ["_h1", "_h2", "_salt"]).where(~place.eqNullSafe(F.col("_first")))
    gone = later.groupBy("_k1", "_k2").agg(F.collect_set("_at").alias("_starts")).select(
        "_k1", "_k2", F.array_distinct(F.flatten(F.transform("_starts", lambda i: F.array(*[i + k for k in range(LINES)])))).alias("_gone"))
    joined = rows.join(gone, ["_k1", "_k2"], "left").withColumn("_lines", F.split("_text", "\n"))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone")))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get("_lines", i)), "\n")
    return joined.select(
        "_row", F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(rebuilt).alias("kept_text"))


def deduplicated_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text that is left; a document of which no line is left goes."""
    out = dedup_lines(docs, id_col, text_col).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return out.select(*[(F.col("kept_text") if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
