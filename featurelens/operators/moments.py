"""Co-moments of many columns in one scan: a mergeable, blocked Gram matrix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from featurelens.functions.expressions import as_double, field_type

WIDTH = 512       # columns of a block
MERGERS = 64      # tasks that merge the partial blocks of one block first
SCHEMA = "feature1 string, feature2 string, own boolean, n double, mean1 double, mean2 double, m11 double, m22 double, m12 double"
_PARTIAL = "block int, salt int, state binary"


class _Block:
    """Sums of every pair (column of x, column of y) over the rows that have both, around fixed origins."""

    def __init__(self, x0: np.ndarray, y0: np.ndarray) -> None:
        self.x0, self.y0 = x0, y0
        self.n, self.sx, self.sy, self.qx, self.qy, self.p = np.zeros((6, len(x0), len(y0)))

    def add(self, x: np.ndarray, y: np.ndarray, gaps: bool) -> None:
        """``x`` and ``y``: rows by columns around the origins, zero where missing; ``gaps``: with their masks."""
        (x, mx), (y, my) = x, y
        self.p += x.T @ y
        if gaps:
            self.n += mx.T @ my
            self.sx += x.T @ my
            self.sy += mx.T @ y
            self.qx += (x * x).T @ my
            self.qy += mx.T @ (y * y)
        else:
            self.n += len(x)
            self.sx += x.sum(axis=0)[:, None]
            self.sy += y.sum(axis=0)[None, :]
            self.qx += (x * x).sum(axis=0)[:, None]
            self.qy += (y * y).sum(axis=0)[None, :]

    def state(self) -> np.ndarray:
        """``n``, both means, both squares and the product around the means."""
        n = np.maximum(self.n, 1)
        ax, ay = self.sx / n, self.sy / n

        def around(q: np.ndarray, s: np.ndarray, a: np.ndarray) -> np.ndarray:
            out = q - s * a
            return np.where(out <= 1e-14 * q, 0.0, out)

        return np.stack([self.n, ax + self.x0[:, None], ay + self.y0[None, :], around(self.qx, self.sx, ax), around(self.qy, self.sy, ay), self.p - self.sx * ay])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The state of two disjoint sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    # a side without rows has no mean
    dx, dy = (np.where((a[0] > 0) & (b[0] > 0), b[i] - a[i], 0.0) for i in (1, 2))
    mx, my = (np.where(a[0] > 0, a[i] + d * share, b[i]) for i, d in ((1, dx), (2, dy)))
    w = a[0] * share
    return np.stack([n, mx, my, a[3] + b[3] + dx * dx * w, a[4] + b[4] + dy * dy * w, a[5] + b[5] + dx * dy * w])


def co_moments(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None, width: int = WIDTH) -> DataFrame:
    """One row per pair of a ``left`` and a ``right`` column (all pairs of ``left`` if there is no ``right``), from one scan.

    ``n`` rows that have both values, their means, and sums of squares and products around them (``m11, m22, m12``), from which
    variance, correlation and least squares follow. With ``right``, rows marked ``own`` hold each left column alone. Missing values
    (null, NaN, blank text) count pairwise. An empty table gives rows with n = 0.

    Each task multiplies its Arrow batches into blocks of ``width`` columns and hands on one state per block; states are merged as
    they stream in, first in ``MERGERS`` tasks for each block, then in one. A task holds 48 bytes for every pair; the
    driver holds nothing.
    """
    left, both = list(left), right is None
    right = left if both else list(right)
    cols = list(dict.fromkeys([*left, *right]))
    at = {c: i for i, c in enumerate(cols)}
    li, ri = np.array([at[c] for c in left], int), np.array([at[c] for c in right], int)
    a_blocks = [(a, min(a + width, len(left))) for a in range(0, len(left), width)]
    b_blocks = [(b, min(b + width, len(right))) for b in range(0, len(right), width)]
    pairs = [(a, b) for a in a_blocks for b in b_blocks if not both or b[0] >= a[0]]
    slim = df.select(*[as_double(c, field_type(df, c)).alias(f"c{i}") for i, c in enumerate(cols)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        origin = np.full(len(cols), np.nan)
        blocks: list[_Block] | None = None
        n, s, q = np.zeros((3, len(cols)))

        def take(x: np.ndarray) -> None:
            nonlocal blocks
            mask = ~np.isnan(x)
            gaps = not mask.all()
            for c in np.flatnonzero(np.isnan(origin)):
                # the first batch's mean keeps the sums small; a constant column stays exactly zero
                there = x[mask[:, c], c]
                if len(there):
                    origin[c] = there[0] if (there == there[0]).all() else there.mean()
                    for (a, b), block in zip(pairs, blocks or []):
                        block.x0[li[a[0]:a[1]] == c] = origin[c]
                        block.y0[ri[b[0]:b[1]] == c] = origin[c]
            known = np.nan_to_num(origin)
            if blocks is None:
                blocks = [_Block(known[li[a:b]].copy(), known[ri[c:d]].copy()) for (a, b), (c, d) in pairs]
            x = np.where(mask, x - known, 0.0)
            m = mask.astype(float)
            n[:] += m.sum(axis=0)
            s[:] += x.sum(axis=0)
            q[:] += (x * x).sum(axis=0)
            for ((a, b), (c, d)), block in zip(pairs, blocks):
                block.add((x[:, li[a:b]], m[:, li[a:b]]), (x[:, ri[c:d]], m[:, ri[c:d]]), gaps)

        for batch in batches:
            if batch.num_rows:
                take(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float))
        if blocks is None:
            return
        task = TaskContext.get().partitionId() % MERGERS
        states = [b.state() for b in blocks]
        if not both:
            own = _Block(np.nan_to_num(origin)[li], np.zeros(1))
            own.n, own.sx, own.qx = (v[li][:, None] for v in (n, s, q))
            own.sy, own.qy, own.p = own.sx, own.qx, own.qx
            state = own.state()
            state[2], state[5] = state[1], state[3]
            states.append(state)
        for i, state in enumerate(states):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["block", "salt", "state"])

    def shape(i: int) -> tuple[int, int, int]:
        if i == len(pairs):
            return 6, len(left), 1
        (a, b), (c, d) = pairs[i]
        return 6, b - a, d - c

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        states: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column("block").to_pylist(), batch.column("state")):
                new = np.frombuffer(raw.as_buffer(), float).reshape(shape(i))
                states[i] = _merged(states[i], new) if i in states else new.copy()
        yield from states.items()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, state in together(batches):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([state.tobytes()], pa.binary())], ["block", "salt", "state"])

    def rows_of(i: int, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = i == len(pairs)
        (a, b), (c, d) = ((0, len(left)), (0, 1)) if own else pairs[i]
        for k in range(b - a):
            first = [left[a + k]] * (d - c)
            second = first if own else right[c:d]
            values = [state[v, k] for v in range(6)]
            yield _rows(first, second, own, values)
            if both and c > a:
                yield _rows(second, first, own, [values[v] for v in (0, 2, 1, 4, 3, 5)])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, state in together(batches):
            yield from rows_of(i, state)

    # blocks that no task has seen: an empty table
    none = df.sparkSession.range(len(pairs) + (not both)).select(
        F.col("id").cast("int").alias("block"), F.lit(0).alias("salt")).mapInArrow(_empty_states(shape), _PARTIAL)
    partial = slim.mapInArrow(scan, _PARTIAL)
    once = partial.repartition("block", "salt").mapInArrow(merge, _PARTIAL)
    return once.unionByName(none).repartition("block").mapInArrow(spell, SCHEMA)


def _empty_states(shape):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("block").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([np.zeros(shape(i)).tobytes()], pa.binary())], ["block", "salt", "state"])
    return make


def _rows(first: list[str], second: list[str], own: bool, values: list[np.ndarray]) -> pa.RecordBatch:
    names = ["feature1", "feature2", "own", "n", "mean1", "mean2", "m11", "m22", "m12"]
    return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array([own] * len(first)), *[pa.array(v, pa.float64()) for v in values]], names)


def variance() -> Column:
    """Sample variance of ``feature1``; null for fewer than two values."""
    return F.when(F.col("n") > 1, F.col("m11") / (F.col("n") - 1))


def correlation() -> Column:
    """Pearson correlation of a pair; null for a constant side."""
    r = F.try_divide(F.col("m12"), F.sqrt(F.col("m11")) * F.sqrt(F.col("m22")))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def least_squares(moments: DataFrame, features: Sequence[str], target: str, ridge: float = 0.0) -> dict[str, float]:
    """Coefficients of the line through the centre, and ``intercept``, from all pairs of features and target.

    Only the columns-by-columns matrix reaches the driver. Meant for complete rows; with pairwise gaps the matrix may be singular.
    """
    names = [*features, target]
    at = {c: i for i, c in enumerate(names)}
    m, mean, n = np.zeros((len(names), len(names))), np.zeros(len(names)), 0.0
    for r in moments.where(F.col("feature1").isin(names) & F.col("feature2").isin(names) & ~F.col("own")).collect():
        i, j = at[r["feature1"]], at[r["feature2"]]
        m[i, j] = r["m12"]
        if i == j:
            mean[i], n = r["mean1"], r["n"]
    k = len(features)
    beta = np.linalg.lstsq(m[:k, :k] + ridge * n * np.eye(k), m[:k, k], rcond=None)[0]
    return {**{f: float(b) for f, b in zip(features, beta)}, "intercept": float(mean[k] - beta @ mean[:k])}
