"""Operator 13: the prefix trie of conversations, with totals of every subtree, by van Emde Boas recursion."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from featurelens.llm.text import checkpointed, running
from featurelens.operators.joins import salted_join

SHARED = 100          # conversations of one hundred share the first turns of its first one
HEADS = 6             # fewer than so many shared turns
CHUNK = 4096          # turns of a conversation that one window group sees
PACK_BYTES = 1 << 16
_NONE = hashlib.sha256(b"").hexdigest()


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv, place, item, size``: the turns of every conversation, numbered from 1 in the order of ``turn`` (null first).

    A null role or text is empty. Equal turn numbers stand in the order of the MD5 of the turn's content. ``item`` names
    the content in 128 bits, ``size`` is the code points of its text. Rows without a conversation take no part. Numbers come from a
    running count over ranges of rows, so a conversation with most of the turns is spread over many tasks.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    item = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", F.unhex(item).alias("item"), F.length(text).cast("bigint").alias("size"),
        F.lit(1).cast("bigint").alias("_one"), F.monotonically_increasing_id().alias("_row"))
    counted = running(rows, [F.asc("conv"), F.asc_nulls_first("turn"), F.asc("item"), F.asc("_row")], {"_at": "_one"})
    first = counted.groupBy("conv").agg(F.min("_at").alias("_first"))
    return checkpointed(salted_join(counted, first, ["conv"], salt_by=["_at"]).select("conv", (F.col("_at") - F.col("_first") + 1).alias("place"), "item", "size"))


def rebuilt_turns(turns: DataFrame, shared: int = SHARED, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``conv, depth, item, size`` of the rebuilt conversations, and ``conv, length`` of all of them, turnless ones included.

    The first h turns come from conversation c - c % ``shared`` (all if it has fewer, none if there is none), then the own turns
    after the first h follow; h is the CRC-32 of the decimal c modulo ``heads``.
    """
    placed = ordered_turns(turns)
    lengths = placed.groupBy("conv").agg(F.max("place").alias("own"))
    head = placed.where((F.col("place") < heads) & (F.col("conv") % shared == 0)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "item", "size"))).alias("head"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    plan = lengths.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % shared).alias("base")).join(head, "base", "left")
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<place:bigint,item:binary,size:bigint>>")), F.lit(1), F.col("h").cast("int"))
    plan = checkpointed(plan.select("conv", "own", "h", taken.alias("head")).withColumn("shift", F.col("h") - F.size("head")))
    first = plan.select("conv", F.inline("head")).select("conv", F.col("place").alias("depth"), "item", "size")
    rest = salted_join(placed, plan.select("conv", "h", "shift"), ["conv"], salt_by=["place"]).where(F.col("place") > F.col("h"))
    rows = first.unionByName(rest.select("conv", (F.col("place") - F.col("shift")).alias("depth"), "item", "size"))
    return rows, plan.select("conv", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("bigint").alias("length"))


def named_prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with ``p1, p2``: 128 bits naming the prefix that ends at each turn, equal exactly for equal sequences.

    A name joins the hashes of (depth, item) along the prefix, first within chunks of ``CHUNK`` turns, then over the chunks before.
    """
    chunk = ((F.col("depth") - 1) / F.lit(CHUNK)).cast("bigint")
    tagged = rows.withColumn("_chunk", chunk).withColumn("_a", F.xxhash64("depth", "item")).withColumn("_b", F.xxhash64("item", F.lit("name"), "depth"))
    inside = W.partitionBy("conv", "_chunk").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("conv").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    names = tagged.select("conv", "_chunk", "depth", "size", F.bit_xor("_a").over(inside).alias("_a"), F.bit_xor("_b").over(inside).alias("_b"))
    whole = tagged.where(F.col("_chunk") >= 0).groupBy("conv", "_chunk").agg(F.bit_xor("_a").alias("_wa"), F.bit_xor("_b").alias("_wb"))
    before = whole.select("conv", "_chunk", *[F.coalesce(F.bit_xor(w).over(ahead), F.lit(0)).alias(f"{w}0") for w in ("_wa", "_wb")])
    return names.join(before, ["conv", "_chunk"]).select(
        "conv", "depth", "size", F.col("_a").bitwiseXOR(F.col("_wa0")).alias("p1"), F.col("_b").bitwiseXOR(F.col("_wb0")).alias("p2"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow each other, joined by commas into texts of bounded size."""
    schema = pa.schema([("low", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    key, first, ids, held, done, many = None, None, [], 0, [], 0
    for batch in batches:
        for low, depth, conv in zip(*(batch.column(c).to_pylist() for c in ("low", "depth", "conv"))):
            if key != (low, depth) or held > PACK_BYTES:
                if ids:
                    done.append((*key, first, ",".join(ids)))
                    many += held
                key, first, ids, held = (low, depth), conv, [], 0
                if many > PACK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                    done, many = [], 0
            ids.append(str(conv))
            held += len(ids[-1]) + 1
    if ids:
        done.append((*key, first, ",".join(ids)))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, None
    for batch in batches:
        done = []
        for low, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("low", "depth", "ids"))):
            if key == (low, depth):
                digest.update(b"," + ids.encode())
                continue
            if key:
                done.append((*key, digest.hexdigest()))
            key, digest = (low, depth), hashlib.sha256(ids.encode())
        yield _digest_batch(done)
    if key:
        yield _digest_batch([(*key, digest.hexdigest())])


def _digest_batch(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["low", "depth", "ends"])


def _ends(last: DataFrame) -> DataFrame:
    """``low, depth, ends``: SHA-256 of the ascending ids of the conversations that end at a node, ``last(low, depth, conv)``.

    Sorted ranges are joined into packed texts in parallel; only these meet in one task per node, which hashes them in
    order without holding them.
    """
    ranged = last.repartitionByRange("low", "depth", "conv").sortWithinPartitions("low", "depth", "conv")
    packed = ranged.select("low", "depth", "conv").mapInArrow(_packed, "low long, depth long, first long, ids string")
    return packed.repartition("low", "depth").sortWithinPartitions("low", "depth", "first").select("low", "depth", "ids").mapInArrow(_digests, "low long, depth long, ends string")


def _half(level: int) -> Column:
    """The turns before ``depth`` as a number of half blocks of ``2 ** level`` turns."""
    return F.shiftright(F.col("depth") - 1, level)


def _grafted(nodes: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
    """``nodes(low, depth, up, leaves, saved)`` with ``leaves, saved`` summed over each node's subtree.

    The recursion cuts a trie at half depth into an upper trie and a forest of lower tries, and each of these again, down to single
    nodes. It is unrolled from there: at ``level`` every trie of height ``2 ** level`` has its totals, for all of them in the table at once.
    The totals of a lower trie, whose top nodes hang below a node at the cut, are added to that node and to its ancestors in
    the upper trie, which are on the path of the node's smallest member. A path enters a level once, so a level costs at most the turns.
    """
    level = 0
    while (1 << level) < deepest:
        block = 1 << level
        lower = nodes.where((_half(level) % 2 == 1) & ((F.col("depth") - 1) % block == 0))
        hung = lower.groupBy(F.col("up").alias("conv"), (F.col("depth") - 1).alias("cut")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        above = paths.where(_half(level) % 2 == 0).select("conv", "low", "depth", ((_half(level) + 1) * block).alias("cut"))
        grafts = salted_join(above, hung, ["conv", "cut"], salt_by=["depth"]).groupBy("low", "depth").agg(F.sum("_l").alias("_l"), F.sum("_s").alias("_s"))
        joined = nodes.join(grafts, ["low", "depth"], "left")
        nodes = checkpointed(joined.select(*[c for c in nodes.columns if c not in ("leaves", "saved")], (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"),
                                           (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")))
        level += 1
    return nodes


def prefix_trie(turns: DataFrame, shared: int = SHARED, heads: int = HEADS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations in ``turns(conv_id, turn, role, text)``.

    ``conv_id`` (smallest member) and ``depth`` name a node; ``parent_conv_id`` (null for the root); ``n_convs`` members, ``n_children``,
    ``n_leaves`` childless nodes of the subtree, ``saved_tokens`` summed over the subtree (members less one, times code points of
    the node's last text), ``ends_sha256`` of the members that end there. Also ``n_ends``.

    Null roles and texts are empty, rows without a conversation take no part, ties are ordered by content, repeated rows are turns of
    their own, other columns are not read. An empty table has no nodes, not even the root. Texts are hashed where they are read and
    never shuffled. No group is gathered: turns of a conversation are numbered over ranges, prefixes named by chunks, members counted before
    the shuffle, and keys with many rows salted.
    """
    rows, lengths = rebuilt_turns(turns, shared, heads)
    lengths = checkpointed(lengths)
    named = checkpointed(named_prefixes(rows))
    found = named.groupBy("depth", "p1", "p2").agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("n_convs"), F.first("size").alias("size"))
    found = checkpointed(found)
    paths = checkpointed(salted_join(named.drop("size"), found.select("depth", "p1", "p2", "low"), ["depth", "p1", "p2"], salt_by=["conv"]).select("conv", "depth", "low"))
    root = lengths.agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("n_convs"))
    top = root.where(F.col("n_convs") > 0).select("low", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("up"), "n_convs", F.lit(0).cast("bigint").alias("size"))
    lowest = root.first()["low"]
    # the path of a node's smallest member holds its parent
    parents = paths.select(F.col("conv").alias("low"), (F.col("depth") + 1).alias("depth"), F.col("low").alias("_up"))
    joined = found.join(parents, ["low", "depth"], "left")
    nodes = joined.select("low", "depth", F.when(F.col("depth") == 1, F.lit(lowest)).otherwise(F.col("_up")).cast("bigint").alias("up"), "n_convs", "size").unionByName(top)
    children = nodes.where("depth > 0").groupBy(F.col("up").alias("low"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["low", "depth"], "left").select("low", "depth", "up", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "size")
    nodes = checkpointed(nodes.select("*", (F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.where("depth > 0").select(F.col("low").alias("conv")).distinct()
    totals = _grafted(nodes.where("depth > 0"), checkpointed(salted_join(paths, own, ["conv"], salt_by=["depth"])), deepest)
    whole = totals.where("depth = 1").agg(F.coalesce(F.sum("leaves"), F.lit(0)).alias("l"), F.coalesce(F.sum("saved"), F.lit(0)).alias("s")).first()
    root_row = nodes.where("depth = 0").withColumn("leaves", F.col("leaves") + F.lit(whole["l"])).withColumn("saved", F.col("saved") + F.lit(whole["s"]))
    totals = totals.unionByName(root_row.select(*totals.columns))
    last = salted_join(lengths.where("length > 0").withColumnRenamed("length", "depth"), paths, ["conv", "depth"]).select("low", "depth", "conv").unionByName(
        lengths.where("length = 0").select(F.lit(lowest).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("depth"), "conv"))
    last = checkpointed(last)
    counted = last.groupBy("low", "depth").agg(F.count(F.lit(1)).alias("n_ends"))
    out = totals.join(_ends(last), ["low", "depth"], "left").join(counted, ["low", "depth"], "left")
    return out.select(F.col("low").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
                      F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"), F.coalesce("n_ends", F.lit(0)).alias("n_ends"))
