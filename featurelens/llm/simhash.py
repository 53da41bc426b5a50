"""Operator 3: near-duplicates by SimHash, with a binary trie self-join over the fingerprints."""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from featurelens.llm.text import checkpointed, pack, pieces
from featurelens.operators.components import connected_components
from featurelens.operators.joins import salted_join

BITS, BUDGET = 64, 2
SHINGLE = 3
SEED = 42
# Bits that the trie walks without an error in each rotation: with two errors, one of three parts is free of them.
PARTS = ((0, 22), (22, 21), (43, 21))
STEP = 6             # bits by which a node pair that is too large for a task is taken apart
LEAF = 4096          # fingerprints of a node pair that one task walks
BRUTE = 32           # sides of a pair up to which all pairs are compared at once
CHUNK = 8192


def _hashes(text: bytes, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, in blocks."""
    tail: list[bytes] = []
    shingles = 0
    for part in pieces(text):
        words = tail + part.lower().split()
        if len(words) >= size:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-1])).tolist()
            stops = (ends[size - 1:] - 1).tolist()
            digest = xxhash.xxh64_intdigest
            yield np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, len(stops))
            shingles += len(stops)
        tail = words[max(0, len(words) - size + 1):] if size > 1 else []
    if not shingles and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def simhash(text: bytes | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if it is set in over half of the hashes of the word shingles; 0 for a text without words."""
    if not text:
        return 0
    ones, n = np.zeros(BITS, np.int64), 0
    for block in _hashes(text, size, seed):
        for at in range(0, len(block), CHUNK):
            part = block[at:at + CHUNK].astype("<u8")
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, size: int = SHINGLE, seed: int = SEED) -> Column:
    """The SimHash of a text column as a signed long."""
    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t.as_py(), size, seed) for t in texts], np.uint64).view(np.int64))
    return of(text.cast("binary"))


def _walk(values: np.ndarray, depth: int, mask: int, budget: int = BUDGET, also: np.ndarray | None = None, slack: int = BITS) -> np.ndarray:
    """Spanning forest (pairs of positions) of the links between the two sides of one node pair.

    ``values`` are sorted bit strings of which the first ``depth`` bits are walked; ``mask`` has the bits in which the two
    sides differ so far, none if the pair is a node with itself. Linked pairs differ in at most ``budget`` bits, and in at most ``slack``
    bits of ``also``.
    """
    n = len(values)
    label = np.arange(n)

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            up = label[x]
            if np.array_equal(up, x):
                return x
            x = up

    def link(u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = root(u), root(v)
            apart = u != v
            u, v = u[apart], v[apart]
            np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))

    spent = mask.bit_count()
    if mask:
        top = np.uint64(1 << (BITS - depth + mask.bit_length() - 1))
        cut = int(np.argmax((values & top) != 0)) if ((values & top) != 0).any() else n
        # the sides differ in the highest bit of the mask: all above are equal
        stack = [(0, cut, cut, n, depth, spent)]
    else:
        stack = [(0, n, 0, n, depth, 0)]
    one = np.uint64(1)
    while stack:
        a, b, c, d, at, err = stack.pop()
        if a == b or c == d:
            continue
        if (b - a <= BRUTE and d - c <= BRUTE) or at == BITS:
            apart = np.bitwise_count(values[a:b, None] ^ values[None, c:d])
            near = apart <= budget
            if also is not None:
                near &= np.bitwise_count(also[a:b, None] ^ also[None, c:d]) <= slack
            u, v = np.nonzero(near)
            link(u + a, v + c)
            continue
        bit = one << np.uint64(BITS - 1 - at)
        # within a node the rows are sorted, so the next bit cuts it in two
        m = a + int(np.searchsorted((values[a:b] & bit) != 0, True))
        k = c + int(np.searchsorted((values[c:d] & bit) != 0, True))
        if (a, b) == (c, d):
            stack += [(a, m, a, m, at + 1, err), (m, b, m, b, at + 1, err)]
            if err < budget:
                stack.append((a, m, m, b, at + 1, err + 1))
        else:
            stack += [(a, m, c, k, at + 1, err), (m, b, k, d, at + 1, err)]
            if err < budget:
                stack += [(a, m, k, d, at + 1, err + 1), (m, b, c, k, at + 1, err + 1)]
    up = root(np.arange(n))
    linked = np.nonzero(up != np.arange(n))[0]
    return np.stack([linked, up[linked]], axis=1)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        for turn, depth, mask, group in zip(*(batch.column(c) for c in ("turn", "depth", "mask", "group"))):
            values = group.values.to_numpy(zero_copy_only=False).view(np.uint64)
            shift = np.uint64(turn.as_py())
            turned = values if not shift else (values << shift) | (values >> (np.uint64(BITS) - shift))
            order = np.argsort(turned, kind="stable")
            pairs = _walk(turned[order], depth.as_py(), mask.as_py())
            signed = values[order].view(np.int64)
            us.append(signed[pairs[:, 0]])
            vs.append(signed[pairs[:, 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.array([], np.int64), pa.int64()) for x in (us, vs)], ["u", "v"])


def links(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``u, v``: edges that connect all of the distinct ``prints(fp)`` within ``BUDGET`` bits of each other.

    The trie is walked in three rotations. In each, the first part of the bits takes no error, as one of three parts is
    equal in any two fingerprints with at most two errors; so a node pair starts as a node of that depth with itself. A
    pair holding more than ``leaf`` fingerprints goes down ``STEP`` bits at once: each fingerprint joins the child pairs whose
    differing bits keep within the budget. Smaller pairs are walked to the end in a task, which returns a spanning
    forest, at most one edge for each fingerprint. No pair within the budget is lost, and no task gets more than ``leaf``.
    """
    turns = F.explode(F.array(*[F.struct(F.lit(t).alias("turn"), F.lit(d).alias("depth")) for t, d in PARTS]))
    nodes = prints.select("fp", turns.alias("_t")).select("fp", "_t.turn", "_t.depth", F.lit(0).cast("bigint").alias("mask"))
    turned = "(shiftleft(fp, turn) | if(turn = 0, 0L, shiftrightunsigned(fp, 64 - turn)))"
    top = f"shiftrightunsigned({turned}, 64 - depth)"
    key = ["turn", "depth", "mask", "node"]

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("node", F.expr(f"least({top}, {top} ^ mask)"))

    done = []
    nodes = placed(nodes)
    below = F.array(*[F.lit(x).cast("bigint") for x in range(1 << STEP) if x.bit_count() <= BUDGET])
    while True:
        large = nodes.groupBy(*key).count().where((F.col("count") > leaf) & (F.col("depth") + STEP < BITS)).select(*key, F.lit(True).alias("_large"))
        large = checkpointed(large)
        if large.isEmpty():
            done.append(nodes)
            break
        tagged = checkpointed(nodes.join(large, key, "left"))
        done.append(tagged.where(F.col("_large").isNull()).drop("_large"))
        deeper = tagged.where("_large").select("fp", "turn", (F.col("depth") + STEP).alias("depth"), "mask", F.explode(below).alias("_x")).where(
            F.bit_count("mask") + F.bit_count("_x") <= BUDGET)
        nodes = placed(deeper.select("fp", "turn", "depth", F.expr(f"shiftleft(mask, {STEP}) | _x").alias("mask")))
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    groups = whole.groupBy(*key).agg(F.collect_list("fp").alias("group")).where(F.size("group") > 1)
    return groups.select("turn", "depth", "mask", "group").mapInArrow(_leaves, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """``doc_id, fp, component_id`` for every row: its SimHash and the smallest id reachable over links of at most two bits.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows are rows of their own with the
    same result. Null ids do not count for the smallest id; a component without any other has a null ``component_id``.
    Only distinct fingerprints are joined, so groups of copies cost one fingerprint. An empty table gives no rows.
    """
    narrow = checkpointed(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col)).alias("fp")))
    prints = checkpointed(narrow.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = connected_components(prints.select(F.col("fp").alias("node")), links(prints.select("fp"), leaf))
    member = checkpointed(prints.join(found.select(F.col("node").alias("fp"), "component"), "fp"))
    lowest = member.groupBy("component").agg(F.min("low").alias("component_id"))
    return salted_join(narrow, member.join(lowest, "component").select("fp", "component_id"), ["fp"], salt_by=["doc_id"])


# ---------------------------------------------------------------- copies with edited words

WIDE_SEEDS = (42, 7)      # a word fingerprint for each
WIDE_BUDGET = 5           # bits in which word fingerprints of edited copies differ at most
WIDE_BLOCKS = 7           # blocks of bits; those left by the budget are equal in some choice of them
SHINGLE_SLACK = 18        # bits in which their shingle fingerprints differ at most; those of unrelated texts differ in about 32


def word_hashes(text: bytes | None, seeds: tuple[int, ...] = WIDE_SEEDS) -> list[int]:
    """SimHash of the distinct words, each weighing the root of its count, for every seed. An edited word moves few bits."""
    counts: Counter = Counter()
    for part in pieces(text or b""):
        counts.update(part.lower().split())
    out = []
    weights = np.array([math.isqrt(256 * c) for c in counts.values()], np.int64)
    for seed in seeds:
        h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in counts), np.uint64, len(counts)).astype("<u8")
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), CHUNK):
            ones += weights[at:at + CHUNK] @ np.unpackbits(h[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > weights.sum(), bitorder="little").tobytes(), "little"))
    return out


def fingerprints(text: Column) -> Column:
    """The shingle fingerprint and the word fingerprints, big-endian one after the other."""
    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([np.array([simhash(t), *word_hashes(t)], ">u8").tobytes() for t in (x.as_py() for x in texts)], pa.binary())
    return of(text.cast("binary"))


def _tables() -> list[tuple[list[tuple[int, int]], int]]:
    """For every choice of blocks to be equal: the bits' order as spans ``(from, length)``, and the length of the equal part."""
    cuts = [BITS * i // WIDE_BLOCKS for i in range(WIDE_BLOCKS + 1)]
    spans = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    out = []
    for free in itertools.combinations(range(WIDE_BLOCKS), WIDE_BLOCKS - WIDE_BUDGET):
        out.append(([spans[i] for i in (*free, *sorted(set(range(WIDE_BLOCKS)) - set(free)))], sum(spans[i][1] for i in free)))
    return out


def _reordered(values: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(values)
    for start, length in spans:
        out = (out << np.uint64(length)) | ((values >> np.uint64(BITS - start - length)) & np.uint64((1 << length) - 1))
    return out


def _wide_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _tables()
    for batch in batches:
        us, vs = [], []
        for turn, depth, mask, group in zip(*(batch.column(c) for c in ("turn", "depth", "mask", "group"))):
            names = np.array(group.as_py(), dtype=object)
            parts = np.frombuffer(b"".join(names), ">u8").reshape(len(names), -1).astype(np.uint64)
            seed, table = divmod(turn.as_py(), len(tables))
            values = _reordered(parts[:, 1 + seed], tables[table][0])
            order = np.argsort(values, kind="stable")
            pairs = _walk(values[order], depth.as_py(), mask.as_py(), WIDE_BUDGET, parts[order, 0], SHINGLE_SLACK)
            us += names[order][pairs[:, 0]].tolist()
            vs += names[order][pairs[:, 1]].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])


def wide_links(prints: DataFrame, leaf: int = LEAF) -> DataFrame:
    """``u, v``: edges that connect all of the distinct ``prints(node)`` of edited copies.

    Two are linked if their word fingerprints of one seed differ in at most ``WIDE_BUDGET`` bits and their shingle fingerprints in at
    most ``SHINGLE_SLACK``. The trie is entered once for every choice of blocks of bits that the budget cannot all touch, with those
    bits first. Node pairs over ``leaf`` go down ``STEP`` bits in Spark; one that is still over it at the end holds equal word
    fingerprints and is compared chunk with chunk. So no link is lost and no task gets more than two chunks.
    """
    tables = _tables()

    @arrow_udf("array<struct<turn:int,depth:int,value:bigint>>")
    def entered(names: pa.Array) -> pa.Array:
        parts = np.frombuffer(b"".join(names.to_pylist()), ">u8").reshape(len(names), -1).astype(np.uint64)
        n, many = len(names), len(WIDE_SEEDS) * len(tables)
        values = np.empty((n, many), np.uint64)
        for seed in range(len(WIDE_SEEDS)):
            for t, (spans, _) in enumerate(tables):
                values[:, seed * len(tables) + t] = _reordered(parts[:, 1 + seed], spans)
        turns = np.tile(np.arange(many, dtype=np.int32), n)
        depths = np.tile(np.array([d for _, d in tables] * len(WIDE_SEEDS), np.int32), n)
        rows = pa.StructArray.from_arrays([pa.array(turns), pa.array(depths), pa.array(values.ravel().view(np.int64))], ["turn", "depth", "value"])
        return pa.ListArray.from_arrays(pa.array(np.arange(0, n * many + 1, many, dtype=np.int32)), rows)

    key = ["turn", "depth", "mask", "at"]

    def placed(df: DataFrame) -> DataFrame:
        top = "shiftrightunsigned(value, 64 - depth)"
        return df.withColumn("at", F.expr(f"least({top}, {top} ^ mask)")).withColumn("side", F.expr(f"{top} = at"))

    nodes = placed(prints.select("node", F.inline(entered("node"))).withColumn("mask", F.lit(0).cast("bigint")))
    below = F.array(*[F.lit(x).cast("bigint") for x in range(1 << STEP) if x.bit_count() <= WIDE_BUDGET])
    done = []
    while True:
        # a pair of two nodes of which one is empty has no links: zero chunks
        alone = (F.col("mask") != 0) & ((F.col("ones") == 0) | (F.col("ones") == F.col("count")))
        large = nodes.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.count_if("side").alias("ones")).where(F.col("count") > leaf)
        large = checkpointed(large.select(*key, F.when(alone, F.lit(0)).otherwise(F.ceil(F.col("count") / leaf)).cast("int").alias("chunks")))
        if large.isEmpty():
            done.append(nodes.withColumn("pair", F.lit("")))
            break
        tagged = checkpointed(nodes.join(large, key, "left").where(F.col("chunks").isNull() | (F.col("chunks") > 0)))
        done.append(tagged.where(F.col("chunks").isNull()).drop("chunks").withColumn("pair", F.lit("")))
        # at the end of the bits: chunk with chunk
        own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
        last = tagged.where(F.col("chunks").isNotNull() & (F.col("depth") + STEP >= BITS)).withColumn("_own", own)
        other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
        last = last.withColumn("_other", other).withColumn("pair", F.concat_ws("-", F.least("_own", "_other"), F.greatest("_own", "_other")))
        done.append(last.drop("chunks", "_own", "_other"))
        deeper = tagged.where(F.col("chunks").isNotNull() & (F.col("depth") + STEP < BITS)).select("node", "turn", (F.col("depth") + STEP).alias("depth"), "value", "mask", F.explode(below).alias("_x"))
        deeper = deeper.where(F.bit_count("mask") + F.bit_count("_x") <= WIDE_BUDGET)
        nodes = placed(deeper.select("node", "turn", "depth", "value", F.expr(f"shiftleft(mask, {STEP}) | _x").alias("mask")))
    whole = done[0].select("node", *key, "pair")
    for more in done[1:]:
        whole = whole.unionByName(more.select("node", *key, "pair"))
    groups = whole.groupBy(*key, "pair").agg(F.collect_list("node").alias("group")).where(F.size("group") > 1)
    return groups.select("turn", "depth", "mask", "group").mapInArrow(_wide_leaves, "u binary, v binary").distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """The columns of ``docs``; of each group of near-duplicates the row with the smallest id stays (null last; then by the hash of the row).

    Texts are linked as in ``near_duplicates``, and also if a few words were edited (``wide_links``). Null, empty and blank texts are
    one group. Rows that repeat an id with other texts are texts of their own, and each group keeps exactly one row whatever its
    ids are. An empty table gives no rows. Very long texts are read in pieces.
    """
    rows = pack(docs)
    named = checkpointed(rows.select(F.xxhash64("_row").alias("_h1"), F.xxhash64(F.lit("row"), "_row").alias("_h2"), F.col(f"_row.{id_col}").alias("id"),
                                     fingerprints(F.col(f"_row.{text_col}")).alias("node")))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "_h1", "_h2")
    prints = checkpointed(named.groupBy("node").agg(F.min(place).alias("low"), F.count(F.lit(1)).alias("n")))
    shingle = F.conv(F.hex(F.substring("node", 1, 8)), 16, -10).cast("bigint")
    by_print = checkpointed(prints.select("node", shingle.alias("fp")))
    heads = by_print.groupBy("fp").agg(F.min("node").alias("head"))
    near = links(heads.select("fp"), leaf)
    edges = near.join(heads.select(F.col("fp").alias("u"), F.col("head").alias("hu")), "u").join(heads.select(F.col("fp").alias("v"), F.col("head").alias("hv")), "v").select(
        F.col("hu").alias("u"), F.col("hv").alias("v"))
    same = salted_join(by_print, heads, ["fp"], salt_by=["node"]).where(F.col("node") != F.col("head")).select(F.col("node").alias("u"), F.col("head").alias("v"))
    found = connected_components(prints.select("node"), edges.unionByName(same).unionByName(wide_links(prints.select("node"), leaf)))
    kept = found.join(prints, "node").groupBy("component").agg(F.min("low").alias("low")).select(
        F.col("low._h1").alias("_h1"), F.col("low._h2").alias("_h2"))
    # equal rows have equal hashes: one of them stays, chosen before the shuffle in every task that holds some
    keyed = rows.withColumn("_h1", F.xxhash64("_row")).withColumn("_h2", F.xxhash64(F.lit("row"), "_row"))
    once = F.row_number().over(W.partitionBy("_h1", "_h2").orderBy("_h1"))
    return salted_join(keyed, kept, ["_h1", "_h2"], salt_by=["_h1"]).withColumn("_n", once).where("_n = 1").select("_row.*")
