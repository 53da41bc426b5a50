"""Operator 8: quality classifier, a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import checkpointed, held_out, pieces

SHRINK = 0.2            # part of the pooled covariance in each class covariance
RIDGE = 0.02            # part of the unit matrix (statistics are standardised)
WIDEST = 8.0            # standardised statistics are cut here, so that one odd statistic does not decide alone
NEUTRAL = 0.5           # score without any label
# Few characters or words say little: shares are mixed with those of plain prose, held by so many characters and words.
PRIOR_CHARS, PRIOR_WORDS = 60, 10
PROSE = {"upper": 0.03, "digits": 0.005, "marks": 0.03, "signs": 0.0, "length": 6.0, "repeats": 0.02, "line": 15.0, "entropy": 4.3}

STATISTICS = ["words", "word length", "upper", "digits", "marks", "signs", "lines", "repeats", "variety", "entropy", "long words"]
_upper, _digit = np.zeros(256), np.zeros(256)
_upper[65:91] = 1
_digit[48:58] = 1
_mark, _sign = np.zeros(256), np.zeros(256)
_mark[list(b".,;:'\"()?-")] = 1
_sign[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 1


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a whole text; zeros for a null or empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    bytes_seen, words, repeats, long_words, distinct, last = np.zeros(256), 0, 0, 0, set(), None
    for part in pieces(text):
        bytes_seen += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        found = part.split()
        if not found:
            continue
        words += len(found)
        repeats += sum(map(eq, found, found[1:])) + (found[0] == last)
        long_words += sum(len(w) > 20 for w in found)
        distinct.update(found)
        last = found[-1]
    n = bytes_seen.sum()
    share = bytes_seen[bytes_seen > 0] / n
    letters = n - bytes_seen[[32, 9, 10, 11, 12, 13]].sum()
    root = np.sqrt

    def mixed(found: float, prose: str, seen: float, prior: float) -> float:
        return (found + PROSE[prose] * prior) / (seen + prior)

    shares = [root(mixed(bytes_seen @ kind, name, letters, PRIOR_CHARS)) for kind, name in ((_upper, "upper"), (_digit, "digits"), (_mark, "marks"), (_sign, "signs"))]
    return [float(x) for x in (
        np.log1p(words), np.log1p(mixed(letters, "length", words, PRIOR_WORDS)), *shares, np.log1p(mixed(words, "line", 1 + bytes_seen[10], 1)),
        root(mixed(repeats, "repeats", words, PRIOR_WORDS)), np.log1p(len(distinct) + PRIOR_WORDS) / np.log1p(words + PRIOR_WORDS),
        mixed(-(share @ np.log2(share)) * n, "entropy", n, 2 * PRIOR_CHARS), root(long_words / max(words, 1)))]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats``: one narrow row for each document, from one pass over the texts."""
    @arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))
    return docs.select(F.col(id_col).alias("doc_id"), of(F.col(text_col).cast("binary")).alias("stats"))


@dataclass
class QuadraticModel:
    """Class means, inverse Cholesky factors and log terms; None where only a prior is known."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    terms: np.ndarray
    prior: float | None = None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(rows), self.prior)
        x = np.clip((rows - self.centre) / self.scale, -WIDEST, WIDEST)
        density = [term - 0.5 * (((x - mean) @ factor.T) ** 2).sum(axis=1) for mean, factor, term in zip(self.means, self.factors, self.terms)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


def fit_quality(rows: DataFrame, shrink: float = SHRINK, ridge: float = RIDGE) -> QuadraticModel:
    """Fit on ``rows(stats, label)`` from sums over all of them: counts, sums and products for each class.

    The covariance of a class is mixed with the pooled one and with the unit matrix, and its Cholesky factor is kept.
    With one class, the score is that label; without labels it is 0.5.
    """
    d = len(STATISTICS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist()).reshape(-1, d)
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[label == c]
                out[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], ["at", "v"])

    total = np.zeros(2 * (1 + d + d * d))
    for at, v in rows.where(F.col("label").isin(0, 1)).select("stats", F.col("label").cast("int")).mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v")).collect():
        total[at] = v
    total = total.reshape(2, -1)
    n = total[:, 0]
    if (n == 0).any():
        return QuadraticModel(*[np.zeros(0)] * 5, prior=NEUTRAL if not n.any() else float(n[1] > 0))
    mean_all = total[:, 1:1 + d].sum(axis=0) / n.sum()
    products = total[:, 1 + d:].reshape(2, d, d)
    spread = np.sqrt(np.maximum(np.diag(products.sum(axis=0)) / n.sum() - mean_all ** 2, 0))
    scale = np.where(spread > 1e-9, spread, 1)
    means = (total[:, 1:1 + d] / n[:, None] - mean_all) / scale
    raw = total[:, 1:1 + d] / n[:, None]
    own = [(products[c] / n[c] - np.outer(raw[c], raw[c])) / np.outer(scale, scale) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, terms = [], []
    for c in (0, 1):
        low = np.linalg.cholesky((1 - shrink) * own[c] + shrink * pooled + ridge * np.eye(d))
        factors.append(np.linalg.inv(low))
        terms.append(np.log(n[c] / n.sum()) - np.log(np.diag(low)).sum())
    return QuadraticModel(mean_all, scale, means, np.array(factors), np.array(terms))


def scored(rows: DataFrame, model: QuadraticModel) -> Column:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def of(stats: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(np.array(stats.to_pylist(), float).reshape(-1, len(STATISTICS))))
    return of("stats")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` for every row of ``docs``; the score is the probability of label 1.

    Statistics cover whole texts; a null or empty text has all of them zero and gets a score like any other. Labels of the
    held-out fifth are never read; null labels and labels of unknown ids do not count; repeated labels count each. Repeated
    rows are scored each. An empty table gives no rows.
    """
    rows = checkpointed(with_statistics(docs, id_col, text_col))
    learn = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & ~held_out("doc_id"))
    model = fit_quality(rows.where(~held_out("doc_id")).join(learn, "doc_id"))
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), scored(rows, model).alias("score"))
