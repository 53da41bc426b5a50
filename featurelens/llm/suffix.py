"""Operator 10: repeated passages: suffixes retained at shared minimisers, then an exact join of their 50-word runs by 128-bit hashes.

No suffix is sorted and no neighbours are compared or extended: adjacent suffixes alone lose matches in groups of edited copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import checkpointed, pack, pieces, row_key

LEAST = 50              # words of a passage
PREFIX = 16             # words that a retained suffix must share with one of another text
CHUNK = 1 << 20
HOT = 1000              # documents from which on the runs at a suffix are salted
SALTS = 32              # tasks over which they are dealt; at most 32, a bit of an int each
_even, _odd = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    parts = [np.fromiter(map(digest, words), np.uint64, len(words)) for words in (p.split() for p in pieces(text))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _join(a: np.ndarray, b: np.ndarray, factor: np.uint64) -> np.ndarray:
    out = (a * factor) ^ (b + (a >> np.uint64(31)))
    out *= factor
    return out ^ (out >> np.uint64(29))


def _spans(words: np.ndarray, length: int, factor: np.uint64) -> np.ndarray:
    """Hashes of all runs of ``length`` words, put together from runs of 1, 2, 4, ... words."""
    run, size, out, at = words, 1, None, 0
    while length:
        if length & 1:
            here = run[at:]
            out = here if out is None else _join(out[:len(here)], here, factor)
            at += size
        length >>= 1
        if length:
            run = _join(run[:-size], run[size:], factor) if len(run) > size else run[:0]
            size *= 2
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def _chunks(words: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    for at in range(0, len(words) - least + 1, CHUNK):
        yield at, words[at:at + CHUNK + least - 1]


def minimisers(words: np.ndarray, least: int, prefix: int) -> np.ndarray:
    """For each run of ``least`` words the smallest hash of ``prefix`` words in it: the suffix retained for that run.

    Two places with the same run retain the same suffix at the same distance, so no common run is lost.
    """
    return _least(_spans(words, prefix, _even), least - prefix + 1)


def _retained(least: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0, np.uint64)]
            for text in batch.column(1):
                words = word_hashes(text.as_py() or b"")
                out.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(minimisers(w, least, prefix)) for _, w in _chunks(words, least)]])))
            key = np.repeat(batch.column(0).to_numpy(), [len(x) for x in out[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(key)], ["h", "d1"])
    return run


def _extended(least: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, text, kept, hot in zip(*batch.columns):
                wanted = np.sort(kept.values.to_numpy().view(np.uint64))
                common = np.isin(wanted, hot.values.to_numpy().view(np.uint64))
                salt = (tid.as_py() + (tid.as_py() >> 33)) % SALTS
                for at, words in _chunks(word_hashes(text.as_py() or b""), least):
                    here = minimisers(words, least, prefix)
                    slot = np.minimum(np.searchsorted(wanted, here), len(wanted) - 1)
                    where = np.nonzero(wanted[slot] == here)[0]
                    w1, w2 = (_spans(words, least, f)[where].view(np.int64) for f in (_even, _odd))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(w1), pa.array(w2), pa.array(np.full(len(where), tid.as_py())), pa.array((where + at).astype(np.int32)),
                         pa.array(np.where(common[slot[where]], salt, 0).astype(np.int32))], ["w1", "w2", "tid", "at", "salt"])
    return run


def _merged(starts: Column, least: int) -> Column:
    """Starts of runs of ``least`` words as a list of disjoint spans: start, end, start, end, ..."""
    @arrow_udf("array<int>")
    def merge(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows:
            if not row.is_valid or not len(row.values):
                out.append([])
                continue
            s = np.unique(row.values.to_numpy())
            new = np.concatenate(([True], s[1:] > s[:-1] + least))
            ends = np.concatenate((s[:-1][new[1:]], s[-1:])) + least
            out.append(np.stack([s[new], ends], axis=1).ravel().tolist())
        return pa.array(out, pa.list_(pa.int32()))
    return merge(starts)


def _length(spans: Column) -> Column:
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("bigint"), lambda s, x: x - s), F.lit(0).cast("bigint"))


def repeated_passages(docs: DataFrame, least: int = LEAST, prefix: int = PREFIX, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_words, spans, later, n_repeated, n_later`` and the row's key ``_k1, _k2`` for every row of ``docs``.

    ``spans`` are the word spans of passages of at least ``least`` words (runs between white space, compared as they are)
    that stand in more than one document; ``later`` are those parts that an earlier document has: documents are ordered by
    (smallest id with that text, null first; hashes of the text; key of the row). Repetition within one document alone
    does not count. Null, empty and short texts have no passage. Rows that repeat both id and text are one document
    and get the same result. An empty table gives no rows.

    Of each run of ``least`` words the suffix at its minimiser is retained. Equal texts are one. Suffixes that do not
    share their first ``prefix`` words with a suffix of another text are dropped (a filter only, by 64-bit hashes). All runs of
    ``least`` words that retain one of the others are joined by 128-bit hashes, and runs found in two texts mark their words. This
    stands in place of sorting, comparing neighbours and extending: the adjacent suffix only would lose matches in groups of edited copies,
    where the best partner to the right is another than the one to the left; so all runs are compared, by 128-bit hashes.
    Runs at a suffix of more than ``hot`` documents are dealt over ``SALTS`` tasks by text; which of these hold a run is kept as
    bits, so its first place is copied to no more tasks than the run has places.
    """
    doc_id, text = F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}")
    digest = [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit("text"), text, F.length(text)).alias("d2")]
    rows = pack(docs).select(doc_id.cast("bigint").alias("doc_id"), text.cast("binary").alias("text"), *digest, *row_key(doc_id, text))
    counted = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    narrow = checkpointed(rows.select("doc_id", "d1", "d2", "_k1", "_k2", counted.alias("n_words")))
    key = F.struct("doc_id", "_k1", "_k2")
    texts = narrow.where(F.col("n_words") >= least).groupBy("d1", "d2").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    # a number for each text, in the order of texts
    texts = checkpointed(texts.orderBy("first", "d1", "d2").withColumn("tid", F.monotonically_increasing_id()))
    suffixes = rows.where(F.col("text").isNotNull()).select("d1", "text").mapInArrow(_retained(least, prefix), "h long, d1 long")
    shared = suffixes.groupBy("h").agg(F.min("d1").alias("a"), F.max("d1").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b").select("h", (F.col("n") > hot).alias("hot"))
    kept = suffixes.join(shared, "h").groupBy("d1").agg(F.collect_set("h").alias("kept"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    ours = checkpointed(texts.select("tid", "d1", F.col("first._k1").alias("_k1"), F.col("first._k2").alias("_k2")).join(kept, "d1").drop("d1"))
    runs = rows.select("_k1", "_k2", "text").join(ours, ["_k1", "_k2"]).select("tid", "text", "kept", "hot").mapInArrow(_extended(least, prefix), "w1 long, w2 long, tid long, at int, salt int")
    twice = runs.groupBy("w1", "w2").agg(F.min("tid").alias("lead"), F.max("tid").alias("tail"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts")).where("lead <> tail")
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    marked = runs.join(twice.select("w1", "w2", "lead", F.explode(salts).alias("salt")), ["w1", "w2", "salt"]).groupBy("tid").agg(F.collect_set("at").alias("starts"), F.collect_set(F.when(F.col("lead") != F.col("tid"), F.col("at"))).alias("later"))
    marked = marked.select("tid", _merged(F.col("starts"), least).alias("spans"), _merged(F.col("later"), least).alias("later"))
    of_text = checkpointed(texts.join(marked, "tid", "left"))
    # every document with that text: a copy of another document is repeated, and if not the first, later, as a whole
    whole = F.array(F.lit(0), F.col("n_words").cast("int"))
    none = F.array().cast("array<int>")
    out = narrow.join(of_text, ["d1", "d2"], "left")
    copied = F.col("first") != F.col("last")
    out = out.select("doc_id", "n_words", "_k1", "_k2", F.when(copied, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
                     F.when(copied & (F.col("first") != key), whole).otherwise(F.coalesce("later", none)).alias("later"))
    return out.select("*", _length(F.col("spans")).alias("n_repeated"), _length(F.col("later")).alias("n_later"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with all places of repeated passages but the first cut from the texts; white space around a cut is one space."""
    found = repeated_passages(docs, id_col=id_col, text_col=text_col, **options).where("n_later > 0").select("_k1", "_k2", "later").dropDuplicates(["_k1", "_k2"])

    @arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, span in zip(texts.to_pylist(), spans.to_pylist()):
            words = text.split()
            gone = np.zeros(len(words), bool)
            for i in range(0, len(span), 2):
                gone[span[i]:span[i + 1]] = True
            out.append(b" ".join(w for w, g in zip(words, gone) if not g).decode())
        return pa.array(out, pa.string())

    rows = pack(docs)
    rows = rows.select("_row", *row_key(F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}"))).join(found, ["_k1", "_k2"], "left")
    hit = F.col("later").isNotNull()
    left = cut(F.when(hit, F.col(f"_row.{text_col}").cast("binary")).otherwise(F.lit(b"")), F.coalesce("later", F.array().cast("array<int>")))
    rows = rows.withColumn("_left", left)
    return rows.select(*[(F.when(hit, F.col("_left")).otherwise(F.col(f"_row.`{c}`")) if c == text_col else F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
