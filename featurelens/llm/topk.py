"""Operator 7: exact top-k by inner product, norm-sorted with SVD-rotated partial sums and Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.llm.text import checkpointed

QUERIES = 2048          # queries in one broadcast block
SEEDS = 2048            # longest vectors, which give the first thresholds
CHUNK = 1024            # candidates compared at once
ENERGY = 0.8            # part of the squared length that the first rotated components hold on average
DENSE = 1 / 16          # part of pairs left by the bound from which a whole product is cheaper than single pairs
EXACT = 2 ** 53


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``vec_id, v`` with v = floor(scale * x); vectors that are null or hold null or non-finite components take no part."""
    x = F.col("v")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(usable)
    return rows.select("vec_id", F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; floats are used where they cannot round."""
    if q.size and x.size and q.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max()) < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Searcher:
    """One block of queries with rotation, running best scores and thresholds."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, rotation: np.ndarray, head: int, k: int):
        self.ids, self.q, self.head, self.k = ids, q, head, k
        self.rotation = rotation
        turned = q @ rotation
        self.near = turned[:, :head]
        self.rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        self.least = np.full(len(q), -np.inf)           # no smaller score can be among the best
        self.reset()

    def reset(self) -> None:
        n = len(self.q)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.n = n

    def active(self, longest: float) -> np.ndarray:
        """Queries that a vector of this length can still serve."""
        return np.nonzero(self.length * longest * (1 + 1e-9) + 1e-6 >= self.least)[0]

    def offer(self, ids: np.ndarray, x: np.ndarray, lengths: np.ndarray) -> bool:
        """Take a chunk of candidates, longest first; False if none can matter any more."""
        own = self.active(float(lengths.max(initial=0)))
        if not len(own):
            return False
        turned = x @ self.rotation
        rest = np.sqrt((turned[:, self.head:] ** 2).sum(axis=1))
        bound = self.near[own] @ turned[:, :self.head].T + self.rest[own, None] * rest[None]
        slack = 1e-9 * self.length[own, None] * lengths[None] + 1e-6
        left = bound + slack >= self.least[own, None]
        at, which = np.nonzero(left)
        if len(at) > DENSE * left.size:
            score = _products(self.q[own], x)[at, which]
        else:
            score = np.concatenate([np.zeros(0, np.int64), *[np.einsum("ij,ij->i", self.q[own[at[i:i + 8192]]], x[which[i:i + 8192]]) for i in range(0, len(at), 8192)]])
        query = own[at]
        good = (score >= self.least[query]) & (ids[which] != self.ids[query])
        self.merge(query[good], score[good], ids[which[good]])
        return True

    def merge(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(self.found, (query, score, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        starts = np.searchsorted(query, np.arange(self.n))
        rank = np.arange(len(query)) - starts[query]
        last = rank == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[last])
        self.found = tuple(c[rank < self.k] for c in (query, score, ids))


def _gram(dims: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(batch.column(0), dims).astype(np.float64)
            out += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims), pa.int32()), pa.array(out.ravel())], ["at", "v"])
    return sums


def _search(shared, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        searcher = Searcher(block["ids"], block["q"], block["rotation"], block["head"], block["k"])
        searcher.least = block["least"].copy()
        going = True
        for batch in batches:
            if not going:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            lengths = batch.column(2).to_numpy()
            for at in range(0, len(ids), CHUNK):
                going = going and searcher.offer(ids[at:at + CHUNK], x[at:at + CHUNK], lengths[at:at + CHUNK])
        query, score, found = searcher.found
        yield pa.RecordBatch.from_arrays([pa.array(block["ids"][query]), pa.array(found), pa.array(score)], ["query_id", "vec_id", "score"])
    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", block: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its ``k`` highest integer inner products, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``; the candidates are all rows but those with the query's own id. Vectors that are
    null or hold a null or non-finite component take no part, nor do null ids. Vectors are compared with those of the same
    number of components; two empty ones score 0. A repeated query id searches once, with its smallest vector; repeated
    candidates are candidates each. Sums must fit 64 bits. An empty table gives no rows.

    The vectors are dealt by descending length and stay so, on disk. A rotation by the singular vectors of all of them
    gathers most of the length in few components. For each block of queries, exact scores with the longest vectors give first
    thresholds; a task then goes down its range, stops once no length can reach a threshold, adds up the first rotated
    components, bounds the others by Cauchy-Schwarz, and computes the exact integer score only where the bound reaches
    the threshold. A task returns at most ``k`` rows for each query, and only those over the threshold.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vec_col, scale)
    rows = rows.select("vec_id", F.when(F.size("v") == 0, F.array(F.lit(0).cast("bigint"))).otherwise(F.col("v")).alias("v"), F.size("v").alias("size"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    rows = rows.withColumn("length", length).repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"))
    rows = checkpointed(rows)
    parts = []
    for size in sorted(r["size"] for r in rows.select("size").distinct().collect()):
        same, dims = rows.where(F.col("size") == size), max(size, 1)
        gram = np.zeros(dims * dims)
        for at, v in same.select("v").mapInArrow(_gram(dims), "at int, v double").groupBy("at").agg(F.sum("v")).collect():
            gram[at] = v
        energy, rotation = np.linalg.eigh(gram.reshape(dims, dims))
        energy, rotation = np.maximum(energy[::-1], 0), rotation[:, ::-1].copy()
        held = np.cumsum(energy) / energy.sum() if energy.sum() > 0 else np.ones(dims)
        head = int(np.searchsorted(held, ENERGY) + 1)
        seeds = same.orderBy(F.desc("length"), "vec_id").limit(SEEDS).toArrow()
        seed_ids, seed_rows, seed_lengths = seeds.column("vec_id").to_numpy(), _matrix(seeds.column("v").combine_chunks(), dims), seeds.column("length").to_numpy()
        queries = checkpointed(same.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
        n = -(-queries.count() // block)
        for i in range(n):
            mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).toArrow()
            if not mine.num_rows:
                continue
            ids, q = mine.column("vec_id").to_numpy(), _matrix(mine.column("v").combine_chunks(), dims)
            first = Searcher(ids, q, rotation, head, k)
            for at in range(0, len(seed_ids), CHUNK):
                first.offer(seed_ids[at:at + CHUNK], seed_rows[at:at + CHUNK], seed_lengths[at:at + CHUNK])
            shared = spark.sparkContext.broadcast({"ids": ids, "q": q, "rotation": rotation, "head": head, "k": k, "least": first.least})
            parts.append(same.select("vec_id", "v", "length").mapInArrow(_search(shared, dims), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
