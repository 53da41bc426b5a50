"""Operator 5: language identification by nearest centroids of TF-IDF character n-grams, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import bounded_sample, checkpointed, held_out, pack, pieces

WIDTH = 4096            # hashed n-grams
SAMPLE = 1000           # documents for each language that the centroids are fitted on
CENTROIDS = 3
ROUNDS = 8
SLACK = 0.5             # a text is rejected below this part of the least similarity seen in the fit
SHORT = 500             # the similarity that a text of n grams can reach is taken to grow with sqrt(n / (n + SHORT))
UNKNOWN = "und"
FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


def gram_counts(text: bytes) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of the lower-cased characters, ASCII other than letters read as a space."""
    out = np.zeros(WIDTH, np.int64)
    for part in pieces(text):
        chars = np.frombuffer((" " + part.decode("utf-8", "replace").lower() + " ").encode("utf-32-le", "replace"), np.uint32)
        chars = np.where((chars < 128) & ((chars < 97) | (chars > 122)), np.uint32(32), chars)
        h = np.zeros(len(chars), np.uint32)
        for n, factor in enumerate(FACTORS):
            h = (h[:len(chars) - n] + chars[n:] + np.uint32(n + 1)) * factor
            h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(WIDTH - 1), minlength=WIDTH)
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=-1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


def _reach(grams):
    n = grams / len(FACTORS)
    return np.sqrt(n / (n + SHORT))


@dataclass
class LanguageModel:
    """Languages, centroids (unit rows) with the language of each, idf, and the least similarity that is accepted."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    floor: np.ndarray
    idf: np.ndarray

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        if not len(self.centroids):
            return UNKNOWN, 0.0, True
        counts = gram_counts(text)
        near = self.centroids @ _unit(np.log1p(counts) * self.idf)
        best = int(np.argmax(near))
        return self.languages[self.owner[best]], float(min(max(near[best], 0.0), 1.0)), bool(near[best] < self.floor[best] * _reach(counts.sum()))


def _cluster(idf: np.ndarray, centroids: int):
    def fit(group: pd.DataFrame) -> pd.DataFrame:
        rows = _unit(np.stack(group.sort_values("h")["tf"].to_list()).astype(np.float64) * idf)
        centres = rows[:1]
        while len(centres) < min(centroids, len(rows)):             # farthest first
            centres = np.vstack([centres, rows[np.argmin((rows @ centres.T).max(axis=1))]])
        for _ in range(ROUNDS):
            own = np.argmax(rows @ centres.T, axis=1)
            centres = _unit(np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))]))
        least = float(((rows @ centres.T).max(axis=1) / _reach(group.sort_values("h")["grams"].to_numpy())).min())
        return pd.DataFrame({"lang": group["lang"].iloc[0], "centre": list(centres.astype(np.float32)), "least": least})
    return fit


def fit_language(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on at most ``sample`` documents of each language, those with the smallest hashes of their ids.

    The model (a few vectors for each language) comes back to the driver; the texts do not.
    """
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull())
    known = known.withColumn("h", F.xxhash64("id", F.lit("language")))
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [gram_counts(t.as_py()) for t in batch.column(2)]
            tf = pa.array([np.log1p(c).astype(np.float32) for c in counts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tf, pa.array([int(c.sum()) for c in counts], pa.int64())], ["lang", "h", "tf", "grams"])

    rows = bounded_sample(known, "lang", "h", sample).where(F.col("text").rlike(r"\p{L}"))
    rows = checkpointed(rows.select("lang", "h", F.col("text").cast("binary")).mapInArrow(vectors, "lang string, h long, tf array<float>, grams long"))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WIDTH, np.int64), 0
        for batch in batches:
            for tf in batch.column(0):
                seen += tf.values.to_numpy() > 0
                n += 1
        at = np.nonzero(seen)[0]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *seen[at]], pa.int64())], ["at", "n"])

    count = dict(map(tuple, rows.select("tf").mapInArrow(presence, "at int, n long").groupBy("at").agg(F.sum("n")).collect()))
    total = count.pop(-1, 0)
    idf = np.full(WIDTH, np.log(1 + total))
    for at, n in count.items():
        idf[at] = np.log((1 + total) / (1 + n)) + 0.1
    found = rows.groupBy("lang").applyInPandas(_cluster(idf, centroids), "lang string, centre array<float>, least double").collect()
    if not found:
        return LanguageModel([], np.zeros(0, int), np.zeros((0, WIDTH)), np.zeros(0), np.ones(WIDTH))
    found.sort(key=lambda r: (r["lang"], r["centre"]))
    languages = sorted({r["lang"] for r in found})
    return LanguageModel(languages, np.array([languages.index(r["lang"]) for r in found], int), np.array([r["centre"] for r in found]).reshape(-1, WIDTH),
                         np.array([SLACK * r["least"] for r in found]), idf)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``_row`` with ``lang_pred, score, rejected``.

    ``score`` is the cosine to the nearest centroid. A text is rejected if that, for its length, is less than half of the
    least similarity in the fit, or if it is null or has no letter; the latter are ``und`` with score 0. A model without languages
    rejects all texts. Rows are judged one by one, so repeats and empty tables need no care; nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("lang string, score double, rejected boolean")
    def of(texts: pa.Array) -> pa.Array:
        found = [(UNKNOWN, 0.0, True) if not t.is_valid else shared.value.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))], ["lang", "score", "rejected"])

    text = F.col(f"_row.{text_col}")
    legible = F.when(text.rlike(r"\p{L}"), text.cast("binary"))
    return pack(docs).withColumn("_found", of.asNondeterministic()(legible)).select(
        "_row", F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"), F.col("_found.rejected").alias("rejected"))


def known_language_documents(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are."""
    return identify(docs, model, text_col).where(~F.col("rejected")).select("_row.*")


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(F.col(id_col)))
