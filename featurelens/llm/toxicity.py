"""Operator 9: toxicity classifier whose score is trained not to change when identity terms are swapped."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import bounded_sample, checkpointed, held_out, pieces

SAMPLE = 4000           # labelled documents of each class that the classifier is fitted on
SLOTS = 1 << 20         # hashed words and pieces of words
GRAMS = (4, 5)
LEAST_G = 30.0          # a feature takes part if its likelihood ratio statistic against independence of the class reaches this
L2 = 5e-6
FAIR = 1.0              # weight of squared score changes under a swap of identity terms
STEPS = 3000
CACHE = 400_000
NEUTRAL = 0.0           # score without labels of both classes and without toxic ones

# Identity terms, in groups within which one is swapped for the next.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"], ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "arab"], ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "natives", "refugees"], ["old", "young"], ["disabled", "abled"], ["frauen", "männer"], ["femmes", "hommes"], ["mujeres", "hombres"],
]
SWAP = {a: group[(i + 1) % len(group)] for group in IDENTITY for i, a in enumerate(group)}

_word = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"(?<=[.!?\n])\s+|\n")


def words_of(text: bytes) -> Iterator[str]:
    for part in pieces(text):
        yield from _word.findall(part.decode("utf-8", "replace").lower())


def slots(word: str) -> list[int]:
    """Hashed features of a word: the word and its pieces of 4 and 5 characters with marks for start and end."""
    edged = f"<{word}>".encode()
    found = {zlib.crc32(edged) % SLOTS}
    for n in GRAMS:
        found.update(zlib.crc32(edged[i:i + n], n) % SLOTS for i in range(len(edged) - n + 1))
    return list(found)


def features(words: set[str]) -> list[int]:
    """Features of a set of words, once for each word that has them."""
    return [s for w in words for s in slots(w)]


def swapped(text: bytes) -> list[tuple[list[int], list[int]]]:
    """Features of each sentence with identity terms, as it is and with the terms swapped."""
    out = []
    for part in pieces(text):
        lower = part.decode("utf-8", "replace").lower()
        if not any(w in SWAP for w in _word.findall(lower)):
            continue
        for sentence in _sentence.split(lower):
            words = set(_word.findall(sentence))
            if words & SWAP.keys():
                out.append((features(words), features({SWAP.get(w, w) for w in words})))
    return out


@dataclass
class ToxicityModel:
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    prior: float | None = None

    def __post_init__(self):
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        value = self.known.get(word)
        if value is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            get = self.weights.get
            value = self.known[word] = sum(get(s, 0.0) for s in slots(word))
        return value

    def score(self, text: bytes | None) -> float:
        if self.prior is not None:
            return self.prior
        total = self.bias + sum(map(self.word, set(words_of(text or b""))))
        return float(1 / (1 + np.exp(-min(max(total, -500), 500))))


def _fit(labels: np.ndarray, rows: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen slots, weights and bias: logistic loss + L2 + squared score changes under swaps, by accelerated gradient steps."""
    seen = np.zeros((2, SLOTS))
    for y, row in zip(labels, rows):
        seen[y, np.unique(row)] += 1
    n = np.array([(labels == 0).sum(), (labels == 1).sum()])
    table = np.stack([seen, n[:, None] - seen])                     # with and without the feature, by class
    even = table.sum(axis=1, keepdims=True) * table.sum(axis=0, keepdims=True) / n.sum()
    ratio = 2 * (table * np.log(np.where(table > 0, table, 1) / np.where(even > 0, even, 1))).sum(axis=(0, 1))
    chosen = np.nonzero(ratio >= LEAST_G)[0]
    place = np.full(SLOTS, -1)
    place[chosen] = np.arange(len(chosen))

    def sparse(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = [place[x][place[x] >= 0] for x in lists]
        return np.repeat(np.arange(len(own)), [len(o) for o in own]), np.concatenate([*own, np.zeros(0, int)]).astype(int)

    r, c = sparse(rows)
    (a, b), (e, f) = sparse([p[0] for p in pairs]), sparse([p[1] for p in pairs])
    d_row, d_col, d_val = np.concatenate([a, e]), np.concatenate([b, f]), np.concatenate([-np.ones(len(a)), np.ones(len(e))])
    size, m = len(chosen), len(pairs)
    balance = np.where(labels == 1, 1 / (2 * n[1]), 1 / (2 * n[0]))
    lipschitz = 0.25 * float(np.sum(balance * (1 + np.bincount(r, minlength=len(rows))))) + L2
    if m:
        lipschitz += FAIR / m * len(d_row)
    w, v, bias, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(r, v[c], minlength=len(rows)) + vb, -30, 30)))
        g = balance * (p - labels)
        grad = np.bincount(c, g[r], minlength=size) + L2 * v
        if m:
            change = np.bincount(d_row, d_val * v[d_col], minlength=m)
            grad += FAIR / m * np.bincount(d_col, d_val * change[d_row], minlength=size)
        # evidence only adds: harmless words around a toxic one do not hide it
        new, new_bias = np.maximum(v - grad / lipschitz, 0), vb - g.sum() / lipschitz
        momentum = step / (step + 3)
        v, vb = new + momentum * (new - w), new_bias + momentum * (new_bias - bias)
        w, bias = new, new_bias
    return chosen, w, float(bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` labelled documents of each class, those with the smallest hashes of their ids.

    ``docs(doc_id, text)``, ``labels(doc_id, label)``. The chosen ids are at most twice ``sample``, so their broadcast has a proven
    bound. Features come from whole texts in parallel; one task fits the bounded sample.
    """
    ranked = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    ranked = bounded_sample(ranked.withColumn("h", F.xxhash64("doc_id", F.lit("toxicity"))), "label", "h", sample)
    chosen = checkpointed(ranked.select("doc_id", F.col("label").cast("int").alias("label")))
    texts = docs.join(F.broadcast(chosen), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in batches:
            for doc_id, label, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                body = text.as_py() or b""
                rows = [(0, features(set(words_of(body))), None), *[(1, a, b) for a, b in swapped(body)]]
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(rows), pa.int64()), pa.array([label.as_py()] * len(rows), pa.int32()),
                                                  *[pa.array([x[i] for x in rows], kind) for i, kind in enumerate((pa.int32(), ints, ints))]], ["doc_id", "label", "kind", "a", "b"])

    cast = texts.select(F.col("doc_id").cast("bigint"), "label", F.col("text").cast("binary"))
    extracted = checkpointed(cast.mapInArrow(extract, "doc_id long, label int, kind int, a array<int>, b array<int>"))
    # repeated ids could exceed the bound: one text stands for an id, and swaps are bounded alike
    one = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("a")))
    base = extracted.where("kind = 0").withColumn("n", one).where("n = 1").drop("n")
    swaps = extracted.where("kind = 1").orderBy(F.xxhash64("doc_id", "a", "b"), "doc_id").limit(2 * sample)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels_, rows, pairs = [], [], []
        for batch in batches:
            for _, label, kind, a, b in zip(*batch.columns):
                if kind.as_py() == 0:
                    labels_.append(label.as_py())
                    rows.append(a.values.to_numpy())
                else:
                    pairs.append((a.values.to_numpy(), b.values.to_numpy()))
        y = np.array(labels_, int)
        if len(set(labels_)) < 2:
            out = [(-2, float(y[0]) if len(y) else NEUTRAL)]
        else:
            chosen, w, bias = _fit(y, rows, pairs)
            out = [(-1, bias), *zip(chosen.tolist(), w.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64())], ["slot", "weight"])

    fitted = base.unionByName(swaps).orderBy("kind", "doc_id").coalesce(1).mapInArrow(train, "slot int, weight double").collect()
    weights = {r["slot"]: r["weight"] for r in fitted}
    if -1 not in weights:
        return ToxicityModel(prior=weights.get(-2, NEUTRAL))
    return ToxicityModel(bias=weights.pop(-1), weights=weights)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score`` for every row of ``docs``; the score is the probability of label 1.

    Whole texts are scored by their distinct words. A null or empty text has no words and gets the score of the bias. Labels
    of the held-out fifth are never read; null labels do not count; of repeated labels the larger counts. Repeated rows are
    scored each. Labels of one class give that label as score, no labels give 0. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learn = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label")).where(~held_out("doc_id"))
    model = fit_toxicity(rows.where(~held_out("doc_id")), learn, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), of(F.col("text").cast("binary")).alias("score"))
