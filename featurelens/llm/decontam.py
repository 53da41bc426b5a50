"""Operator 4: find documents that hold passages of benchmark items, by a prefix-filtered join verified over item windows."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import checkpointed, pack, pieces, row_key

WINDOW = 13
SHINGLE = 5
SHARE = 20                    # contaminated: one word in this many is hit
INDEX_BYTES = 8_000_000       # window text in one broadcast block
# words: digits, a-z after lower-casing A-Z, and every byte beyond ASCII
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
_mix = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    for part in pieces(text):
        yield part.translate(TABLE).split()


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0), batch.column(1)):
            words = [w for part in words_of(text.as_py() or b"") for w in part]
            size = min(WINDOW, len(words))
            spans = [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if words else []
            yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(spans), pa.string()), pa.array(spans, pa.binary())], ["item_id", "window"])


class WindowIndex:
    """One block of windows: word numbers, windows as rows of numbers, and where their shingles stand."""

    def __init__(self, windows: list[bytes], items: list[list[str]]):
        self.items = items
        split = [w.split(b" ") for w in windows]
        self.vocabulary: dict[bytes, int] = {}
        for words in split:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.sizes = np.array([len(w) for w in split], np.int64)
        self.rows = np.full((len(split), WINDOW), -1, np.int32)
        for row, words in zip(self.rows, split):
            row[:len(words)] = [self.vocabulary[w] for w in words]
        # every shingle of every window, by shingle length: key, window, offset
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in sorted({min(SHINGLE, int(n)) for n in self.sizes}):
            own = np.nonzero(np.minimum(self.sizes, SHINGLE) == k)[0]
            keys, window, offset = [], [], []
            for at in range(WINDOW - k + 1):
                fits = own[self.sizes[own] >= at + k]
                keys.append(self.keys(self.rows[fits][:, at:at + k]))
                window.append(fits)
                offset.append(np.full(len(fits), at, np.int64))
            self.shingles[k] = (np.concatenate(keys), np.concatenate(window), np.concatenate(offset))
        self.distinct = {k: np.unique(s[0]) for k, s in self.shingles.items()}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def keys(rows: np.ndarray) -> np.ndarray:
        """Keys of rows of word numbers; equal keys are verified later."""
        out = np.zeros(len(rows), np.uint64)
        for column in rows.T:
            out = (out + column.astype(np.uint64) + np.uint64(1)) * _mix
            out ^= out >> np.uint64(29)
        return out

    def numbers(self, text: bytes) -> np.ndarray:
        """Word numbers of a text, -1 for words of no window."""
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)) for words in words_of(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def places(self, numbers: np.ndarray, k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose k words have a key in the sorted ``wanted``, and the keys."""
        if len(numbers) < k or not len(wanted):
            return np.array([], np.int64), np.array([], np.uint64)
        known = np.concatenate(([0], np.cumsum(numbers >= 0)))
        at = np.nonzero(known[k:] - known[:-k] == k)[0]
        keys = self.keys(numbers[at[:, None] + np.arange(k)])
        slot = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
        hit = wanted[slot] == keys
        return at[hit], keys[hit]

    def choose(self, counts: dict[int, np.ndarray]) -> None:
        """Keep for each window its rarest shingle: an occurrence of the window cannot do without it."""
        for k, (keys, window, offset) in self.shingles.items():
            seen = counts[k][np.searchsorted(self.distinct[k], keys)]
            order = np.lexsort((offset, seen, window))
            first = order[np.concatenate(([True], np.diff(window[order]) != 0))] if len(order) else order
            first = first[np.argsort(keys[first], kind="stable")]
            self.prefix[k] = (keys[first], window[first], offset[first])
        self.shingles = {}

    def occurrences(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all verified occurrences."""
        starts, windows = [np.array([], np.int64)], [np.array([], np.int64)]
        for k, (keys, window, offset) in self.prefix.items():
            at, found = self.places(numbers, k, keys)
            low, high = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            count = high - low
            entry = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else low, count) + np.arange(count.sum())
            start, win = np.repeat(at, count) - offset[entry], window[entry]
            fits = (start >= 0) & (start + self.sizes[win] <= len(numbers))          # positional and length bounds
            start, win = start[fits], win[fits]
            for j in range(WINDOW):
                rest = self.rows[win, j]
                same = (rest < 0) | (numbers[np.minimum(start + j, len(numbers) - 1)] == rest)
                start, win = start[same], win[same]
            starts.append(start)
            windows.append(win)
        return np.concatenate(starts), np.concatenate(windows)


FOUND = "n_words long, spans array<int>, items array<string>"


def _count(index, text: str, docs: DataFrame) -> dict[int, np.ndarray]:
    """How often each shingle of the block stands in all documents."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = index.value
        counts = {k: np.zeros(len(d), np.int64) for k, d in block.distinct.items()}
        for batch in batches:
            for t in batch.column(0):
                numbers = block.numbers(t.as_py() or b"")
                for k, wanted in block.distinct.items():
                    _, keys = block.places(numbers, k, wanted)
                    np.add.at(counts[k], np.searchsorted(wanted, keys), 1)
        for k, n in counts.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["k", "at", "n"])

    totals = docs.select(F.col(text).cast("binary")).mapInArrow(partial, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    out = {k: np.zeros(len(d), np.int64) for k, d in index.value.distinct.items()}
    k, at, n = (totals.column(c).to_numpy() for c in ("k", "at", "n"))
    for size, counts in out.items():
        counts[at[k == size]] = n[k == size]
    return out


def _blocks(spark: SparkSession, windows: DataFrame, docs: DataFrame, text: str, bound: int) -> list:
    """Broadcast indexes of the windows, each of about ``bound`` bytes of window text."""
    size = windows.agg(F.coalesce(F.sum(F.length("window")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // bound))
    out = []
    for i in range(n):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i).groupBy("window").agg(
            F.concat(F.array_sort(F.collect_set("item_id")), F.when(F.max(F.col("item_id").isNull()), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>"))).alias("items")).toArrow()
        block = WindowIndex(rows.column("window").to_pylist(), rows.column("items").to_pylist())
        plain = spark.sparkContext.broadcast(block)
        block.choose(_count(plain, text, docs))
        plain.unpersist()
        out.append(spark.sparkContext.broadcast(block))
    return out


def _finder(index):
    @arrow_udf(FOUND)
    def find(texts: pa.Array) -> pa.Array:
        block = index.value
        counts, spans, items = [], [], []
        for t in texts:
            numbers = block.numbers(t.as_py() or b"")
            start, window = block.occurrences(numbers)
            edge = np.zeros(len(numbers) + 1, np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + block.sizes[window], -1)
            inside = np.concatenate(([0], (np.cumsum(edge) > 0)[:len(numbers)], [0])) if len(start) else np.zeros(1, int)
            counts.append(len(numbers))
            spans.append(np.nonzero(np.diff(inside))[0].tolist())
            items.append(sorted({i for w in np.unique(window) for i in block.items[w]}, key=lambda i: (i is None, i)))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["n_words", "spans", "items"])
    return find.asNondeterministic()         # it is not; but a filter must not make Spark run it twice


def _covered(spans: Column) -> Column:
    """Words in the union of lists of spans (starts and ends in turn)."""
    @arrow_udf("long")
    def count(rows: pa.Array) -> pa.Array:
        out = []
        for lists in rows.to_pylist():
            n, reach = 0, 0
            for a, b in sorted((x[i], x[i + 1]) for x in lists for i in range(0, len(x), 2)):
                n += max(0, b - max(a, reach))
                reach = max(reach, b)
            out.append(n)
        return pa.array(out, pa.int64())
    return count.asNondeterministic()(spans)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", bound: int = INDEX_BYTES) -> DataFrame:
    """Every row of ``docs`` as ``_row`` with ``n_words, spans, items, n_hit, contaminated``.

    Items are cut into windows of 13 consecutive words, shorter items are one window. Each window's shingles of up to five
    words are ordered by their count over all documents; the rarest is its prefix, as an occurrence of the whole window
    must hold it. A document's shingles are joined with the prefixes; offset and length bound where the window can lie,
    and all its words are then compared. Words inside any occurrence are hit.

    The windows are broadcast in blocks of ``bound`` bytes; each block reads the documents twice (counts, then matches).
    More blocks than one are joined by a 128-bit key of id and text. Null, empty and blank texts have no words and are
    never contaminated; items without words have no window. Items with a null id hit like others; together they are
    one null entry, the last of ``items``. Repeated rows are judged each. An empty table of either kind works. Other columns are carried along whatever their names.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    windows = checkpointed(items.mapInArrow(_item_windows, "item_id string, window binary").distinct())
    blocks = _blocks(spark, windows, docs, text_col, bound)
    rows = pack(docs)
    text = F.col(f"_row.{text_col}").cast("binary")
    found = rows.withColumn("_found", _finder(blocks[0])(text))
    found = found.select("_row", F.col("_found.n_words").alias("n_words"), F.array("_found.spans").alias("_spans"), F.array("_found.items").alias("_items"))
    if len(blocks) > 1:
        key = row_key(F.col(f"_row.{id_col}"), F.col(f"_row.{text_col}"))
        parts = [rows.select(*key, text.alias("_text")).withColumn("_found", _finder(b)("_text")).where(F.size("_found.spans") > 0).select(
            "_k1", "_k2", "_found.spans", "_found.items", F.lit(i).alias("_block")).distinct() for i, b in enumerate(blocks[1:])]
        more = parts[0]
        for p in parts[1:]:
            more = more.unionByName(p)
        more = more.groupBy("_k1", "_k2").agg(F.collect_list("spans").alias("_more_spans"), F.collect_list("items").alias("_more_items"))
        found = found.select("*", *key).join(more, ["_k1", "_k2"], "left").select(
            "_row", "n_words", *[F.concat(a, F.coalesce(F.col(b), F.slice(a, 1, 0))).alias(a) for a, b in (("_spans", "_more_spans"), ("_items", "_more_items"))])
    out = found.withColumn("n_hit", F.when(F.size(F.flatten("_spans")) == 0, F.lit(0).cast("bigint")).otherwise(_covered(F.col("_spans"))))
    return out.select("_row", "n_words", F.col("_spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten("_items"))).alias("items"), "n_hit",
                      ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are."""
    return contamination(docs, benchmark, **options).where(~F.col("contaminated")).select("_row.*")
