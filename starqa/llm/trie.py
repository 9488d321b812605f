"""The trie of conversation prefixes, from vertical bitmaps of turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starqa.llm.common import WORD
from starqa.sources.storage import stored

#: A shard has so many neighbouring conversations (the bits of a bitmap) and so many positions.
BLOCK_BITS, BAND = 8, 64
#: monotonically_increasing_id: the partition is above these bits, the row's place there below.
PLACE_BITS = 33


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), two marks of role and text, and the words of the text, for every turn.

    Turns are ordered by ``turn`` (null first), ties by role and then by a hash
    of the text; null roles and texts count as empty.  Rows without a conv_id
    belong to no conversation.  A conversation may have any number of turns: the
    order is one range partitioning over all of them, and a place is the place
    in the partition plus the turns of that conversation in earlier partitions.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.xxhash64(role, text).alias("m1"), F.xxhash64(F.lit(1), text, role).alias("m2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("place"),
    )
    order = ["conv_id", "turn", "role", "m1", "m2", "place"]
    ranged = slim.repartitionByRange(_parts(slim), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    rows = stored(ranged.select("conv_id", at.alias("at"), "m1", "m2", "words"), "turn-order")
    rows = rows.withColumn("part", F.shiftright("at", PLACE_BITS))
    runs = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(runs, ["conv_id", "part"]).select(
        "conv_id", F.expr("earlier + at - first + 1").alias("pos"), "m1", "m2", "words"
    )


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their turns (conv_id, depth, m1, m2, words) with heads exchanged.

    The first h turns of conversation c become those of conversation c - c % every
    (all if it has fewer, none if it is absent); h is crc32(c as text) modulo
    ``most + 1``.  Conversations that have no turn left stay, with length 0.
    """
    turns = stored(turns, "turns")
    base = F.col("conv_id") - F.col("conv_id") % every
    # At most `most` turns of each conversation are gathered.
    heads = turns.where((F.col("pos") <= most) & (base == F.col("conv_id")))
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "m1", "m2", "words"))).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    counted = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice(F.array(F.struct(*(F.lit(0).cast("long").alias(c) for c in ("pos", "m1", "m2", "words")))), 1, 0))
    convs = counted.select("conv_id", "n", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    convs = convs.select("conv_id", "n", "h", head.alias("head"))
    convs = stored(convs.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")
    own = turns.join(convs.select("conv_id", "h", F.size("head").alias("k")), "conv_id").where("pos > h")
    own = own.select("conv_id", F.expr("k + pos - h").alias("depth"), "m1", "m2", "words")
    lent = convs.select("conv_id", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.m1", "t.m2", "t.words"
    )
    return convs.select("conv_id", "length"), own.unionByName(lent)


def _members(bits: int) -> list[int]:
    found = []
    while bits:
        low = bits & -bits
        found.append(low.bit_length() - 1)
        bits ^= low
    return found


NODE = "k1 long, k2 long, depth long, p1 long, p2 long, least long, n long, saved long, leaves long, ends array<long>"


def _search(shard: pa.Table) -> pa.Table:
    """All nodes of one shard: its conversations' turns in one band of positions.

    The index has a bitmap of conversations for each (position, turn), and for
    each position the turn of every conversation.  Depth first, a node's bitmap
    is met with the bitmaps of the turns that its members have next; every
    meeting that is not empty is a child.  The key of a node is the exclusive or
    of the marks of its path, so that shards agree on it.
    """
    column = lambda name: shard.column(name).to_numpy()
    depth, k1, k2 = column("depth"), column("k1"), column("k2")
    convs, local = np.unique(column("conv_id"), return_inverse=True)
    top = int(depth.min())
    offset = depth - top
    levels = int(offset.max()) + 1

    order = np.lexsort((k2, k1, depth))
    new = np.ones(len(order), bool)
    same = lambda x: x[order][1:] == x[order][:-1]
    new[1:] = ~(same(depth) & same(k1) & same(k2))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    keys = [(int(a), int(b)) for a, b in zip(k1[order][new], k2[order][new])]
    bitmap = [0] * len(keys)
    turn = np.full((levels, len(convs)), -1, np.int64)
    turn[offset, local] = number
    for posting, member in zip(number.tolist(), local.tolist()):
        bitmap[posting] |= 1 << member

    start = offset == 0
    length, later, leaf = (np.zeros(len(convs), np.int64) for _ in range(3))
    for into, name in ((length, "length"), (later, "later"), (leaf, "leaf")):
        into[local[start]] = column(name)[start]
    words = np.zeros((levels, len(convs)), np.int64)
    words[offset[~start], local[~start]] = column("words")[~start]
    saved = (np.cumsum(words[::-1], axis=0)[::-1] + later).tolist()
    turns, lengths, leaves, ids = turn.tolist(), length.tolist(), leaf.tolist(), convs.tolist()

    out: list[tuple] = []
    # What starts at a later band is the last level of the band before it and is reported there.
    stack = [(0, bitmap[p], *keys[p], 0, 0) for p in sorted(set(turns[0]))]
    while stack:
        level, bits, a, b, pa_, pb = stack.pop()
        members = _members(bits)
        at = top + level
        if level or not top:
            ends = [ids[m] for m in members if lengths[m] == at]
            out.append((a, b, at, pa_, pb, ids[members[0]], len(members), sum(saved[level][m] for m in members), sum(leaves[m] for m in members), ends or None))
        if level + 1 < levels:
            following = turns[level + 1]
            for posting in {following[m] for m in members} - {-1}:
                x, y = keys[posting]
                stack.append((level + 1, bits & bitmap[posting], a ^ x, b ^ y, a, b))
    names = ("k1", "k2", "depth", "p1", "p2", "least", "n", "saved", "leaves")
    columns = list(zip(*out)) if out else [()] * 10
    arrays = [pa.array(c, pa.int64()) for c in columns[:9]] + [pa.array(columns[9], pa.list_(pa.int64()))]
    return pa.Table.from_arrays(arrays, names=[*names, "ends"])


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from pieces sorted by node and first id; holds one batch and one hash."""
    now, digest = None, None
    for batch in batches:
        done = []
        keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
        for key, ids in zip(keys, batch.column(3).to_pylist()):
            piece = ",".join(map(str, ids)).encode()
            if key == now:
                digest.update(b"," + piece)
                continue
            if now is not None:
                done.append((*now, digest.hexdigest()))
            now, digest = key, hashlib.sha256(piece)
        yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(*now, digest.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 4
    arrays = [pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations, the empty one included.

    ``conversations``: conv_id and length, each id once; ``turns``: conv_id,
    depth (1 to length), m1, m2, words.  Gives conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    No conversations give no rows, not even a root.

    Shards hold 256 neighbouring conversations and 64 positions, so neither a
    turn that all conversations share nor a conversation of any length makes one
    large; a shard sends a row per node, however many members it has.  Where a
    band does not begin at the root, conversations start at the key of their path
    so far: the exclusive or over whole bands.  A conversation owns the nodes of
    which it is the smallest member, which are the last ones of its path: its
    other turns are what sharing saves, so both sums over subtrees are sums over
    members, taken by a second search once owners are known.  End lists stay in
    pieces of 256 and are hashed in order as they stream by.
    """
    placed = conversations.repartitionByRange(_parts(conversations), "conv_id").sortWithinPartitions("conv_id")
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    convs = stored(placed.select("conv_id", F.col("length").cast("long").alias("length"), block.alias("block")), "blocks")
    paths = turns.join(convs, "conv_id").select(
        "conv_id", "block", "length", F.col("depth").cast("long").alias("depth"), "words",
        F.expr(f"(depth - 1) div {BAND}").alias("band"),
        F.xxhash64("depth", "m1", "m2").alias("k1"), F.xxhash64("m2", "depth", "m1").alias("k2"),
    )
    paths = stored(paths, "paths")

    root = convs.select("conv_id", "block", "length", F.lit(0).cast("long").alias("band"), *(F.lit(0).cast("long").alias(k) for k in ("k1", "k2")))
    longer = paths.where(F.col("length") > BAND)
    whole = longer.groupBy("conv_id", "block", "length", "band").agg(*(F.bit_xor(k).alias(k) for k in ("k1", "k2")))
    so_far = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    later_starts = whole.select(
        "conv_id", "block", "length", (F.col("band") + 1).alias("band"), *(F.bit_xor(k).over(so_far).alias(k) for k in ("k1", "k2"))
    ).where(F.col("band") * BAND < F.col("length"))
    starts = stored(root.unionByName(later_starts), "starts").withColumn("depth", F.col("band") * BAND)

    def searched(starts: DataFrame, paths: DataFrame) -> DataFrame:
        names = ["conv_id", "block", "band", "depth", "k1", "k2", "words", "length", "later", "leaf"]
        none = {n: F.lit(0).cast("long") for n in names}
        rows = starts.withColumns({n: none[n] for n in names if n not in starts.columns}).select(names)
        more = paths.withColumns({n: none[n] for n in names if n not in paths.columns}).select(names)
        return rows.union(more).groupBy("band", "block").applyInArrow(_search, NODE)

    node = ["k1", "k2", "depth"]
    shards = stored(searched(starts, paths), "shard-nodes")
    merged = shards.groupBy(*node).agg(
        F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    merged = stored(merged, "merged-nodes")
    below = merged.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    nodes = merged.join(below.agg(F.count("*").alias("n_children")), node, "left")
    nodes = stored(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    owners = stored(
        nodes.groupBy("conv_id").agg(
            F.min("depth").alias("owned"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf")
        ),
        "owners",
    )
    shared = paths.join(owners.select("conv_id", "owned"), "conv_id", "left").withColumn(
        "words", F.when(F.col("owned").isNull() | (F.col("depth") < F.col("owned")), F.col("words")).otherwise(0)
    ).drop("owned")
    behind = Window.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    later = shared.where(F.col("length") > BAND).groupBy("conv_id", "band").agg(F.sum("words").alias("words"))
    later = later.select("conv_id", "band", F.coalesce(F.sum("words").over(behind), F.lit(0)).alias("later"))
    valued = starts.join(owners.select("conv_id", "leaf"), "conv_id", "left").join(later, ["conv_id", "band"], "left")
    valued = valued.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("leaf", "later")})
    sums = searched(valued, shared).groupBy(*node).agg(
        F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")
    )

    ends = shards.where(F.col("ends").isNotNull()).select(*node, "ends")
    ends = ends.repartition("k1", "k2").sortWithinPartitions(*node, F.col("ends")[0])
    digests = ends.mapInArrow(_digests, "k1 long, k2 long, depth long, ends_sha256 string")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(parents, ["p1", "p2", "depth"], "left")
        .join(sums, node)
        .join(digests, node, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )
