"""Near-duplicate classes by SimHash fingerprints and a covering code.

A fingerprint's 64 bits are cut into blocks of 23, 23, 9 and 9.  Each block has
a perfect code: the binary Golay code, of which every 23-bit word is within 3 of
exactly one codeword, and the two words of nine equal bits, covering radius 4.
An anchor is a codeword of each block.  The anchor nearest to a fingerprint is
its home.

If two fingerprints differ in t bits, t = t1 + .. + t4 by block, then in each
block the second is within radius + ti of the first one's home.  So fingerprints
are replicated to exactly these anchors, about 70 of 2^26, and each meets at its
home all fingerprints that may be near it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starqa.llm.common import chunks, fresh
from starqa.sources.storage import stored

SHINGLE, THRESHOLD, SEED = 3, 2, 42
#: Generator polynomial of the binary Golay code.
GOLAY = 0b101011100011


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes; 0 without words.

    Words of the text with A-Z in lower case; shingles of so many words joined
    by spaces, repeats included; fewer words are one shingle.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = [0, *(end + 1 for end in ends)]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)])
    counts = np.zeros(64, dtype=np.int64)
    rows = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big")


def fingerprints(documents: DataFrame, doc_id: str, text: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``mark`` and ``mark2`` (hashes of id and text) and ``fp`` as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], fp], names=["doc_id", "mark", "mark2", "fp"])

    rows = documents.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *identity(doc_id, text)
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, mark long, mark2 int, fp long")


def identity(doc_id: str, text: str) -> tuple[Column, Column]:
    return F.xxhash64(doc_id, text).alias("mark"), F.hash(doc_id, text).alias("mark2")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: its error pattern; and the codewords to add to the home, by least extra distance.

    Returns errors, then ``first`` (2048 + 1) into ``words`` and ``levels``: the
    codewords other than 0 within 3 + level of an error pattern, level 1 or 2;
    last the syndromes of single bits.
    """
    bits = np.arange(23)
    units = np.array([_remainder(1 << int(b)) for b in bits], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    patterns = [0, *(1 << i for i in range(23))]
    patterns += [1 << i | 1 << j for i in range(23) for j in range(i)]
    patterns += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    for p in patterns:
        errors[_remainder(p)] = p
    codewords = np.array([(m << 11) ^ _remainder(m << 11) for m in range(1, 4096)], dtype=np.int64)
    words, levels, first = [], [], [0]
    for e in errors:
        extra = np.bitwise_count(codewords ^ e).astype(np.int64) - 3
        near = extra <= THRESHOLD
        words.append(codewords[near])
        levels.append(extra[near])
        first.append(first[-1] + int(near.sum()))
    return errors, np.array(first), np.concatenate(words), np.concatenate(levels), units


def _remainder(word: int) -> int:
    for shift in range(word.bit_length() - 12, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GOLAY << shift
    return word


def _golay_block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Homes of 23-bit words; and for each further anchor its word's index, the anchor's and its level."""
    errors, first, words, levels, units = _golay()
    syndrome = np.zeros(len(x), dtype=np.int64)
    for b in range(23):
        syndrome ^= np.where(x >> b & 1, units[b], 0)
    home = x ^ errors[syndrome]
    counts = first[syndrome + 1] - first[syndrome]
    owner = np.repeat(np.arange(len(x)), counts)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[syndrome][owner]
    return home, owner, home[owner] ^ words[at], levels[at]


def _nine_block(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for the code of the two words of nine equal bits; anchors are 0 and 1."""
    ones = np.bitwise_count(x).astype(np.int64)
    home = (ones > 4).astype(np.int64)
    level = 9 - np.minimum(ones, 9 - ones) - 4
    owner = np.flatnonzero(level <= THRESHOLD)
    return home, owner, 1 - home[owner], level[owner]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home anchors of fingerprints; and the index and anchor of every replica, homes included."""
    x = fp.view(np.uint64)
    cut = lambda shift, width: (x >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
    blocks = [(*_golay_block(cut(41, 23)), 25), (*_golay_block(cut(18, 23)), 2), (*_nine_block(cut(9, 9)), 1), (*_nine_block(cut(0, 9)), 0)]
    home = sum(b[0] << b[4] for b in blocks)
    owners, changes = [np.arange(len(x))], [np.zeros(len(x), dtype=np.int64)]
    ones = []
    for own_home, owner, anchor, level, shift in blocks:
        change = (anchor ^ own_home[owner]) << shift
        owners.append(owner)
        changes.append(change)
        ones.append((owner[level == 1], change[level == 1]))
    for i, (owner, change) in enumerate(ones):  # one bit more in each of two blocks
        for other, more in ones[:i]:
            begin, end = np.searchsorted(other, owner), np.searchsorted(other, owner, side="right")
            counts = end - begin
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
            owners.append(np.repeat(owner, counts))
            changes.append(np.repeat(change, counts) ^ more[at])
    owner = np.concatenate(owners)
    return home, owner, home[owner] ^ np.concatenate(changes)


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of the fingerprints in column ``fp`` that differ in at most THRESHOLD bits."""

    def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy()
                _, owner, anchor = anchors(fp)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[owner])], names=["anchor", "b"])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            home, _, _ = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(home), batch.column(0)], names=["anchor", "a"])

    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    at_home = distinct.mapInArrow(homes, "anchor long, a long")
    everywhere = distinct.mapInArrow(replicas, "anchor long, b long")
    # Spark takes replicas for as few as the fingerprints, so neither side may be broadcast.
    return at_home.join(everywhere.hint("merge"), "anchor").where(near).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for all nodes of ``pairs`` (a, b).

    Stars: every node's neighbours are linked to the smallest of them, first
    the larger ones, then the smaller ones, until nothing changes; the number
    of rounds grows with the logarithm of the nodes.  Each round is written
    down, so that the plan stays short and a lost executor costs one round.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.union(edges.select("b", "a")) if larger else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if larger:
            linked = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            linked = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select("m", "u"))
        return linked.where("a <> b").distinct()

    edges, seen = stored(pairs.select("a", "b").distinct(), "links"), None
    while True:
        edges = stored(star(stored(star(edges, True), "large-star"), False), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(edges.select("a", "a")).distinct()


def near_duplicate_classes(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: doc_id, mark, mark2, fp, root and component_id.

    Documents whose fingerprints differ in at most THRESHOLD bits are linked;
    ``root`` is the smallest fingerprint of all that are reachable, and
    ``component_id`` the smallest id of their documents (null ids do not
    count).  Null and empty texts have the fingerprint zero, linked like any
    other.  Other columns of the input are not used.
    """
    rows = stored(fingerprints(documents, doc_id, text, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(links(distinct.select("fp").repartition(parts, "fp")))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(rooted.join(least, "root").select(F.col("fp").alias("of"), "root", "component_id"), "classes")
    return rows.join(classes, F.col("fp") == F.col("of")).drop("of")


def one_of_each_class(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """The documents with the smallest id of each class, one row each, all columns as they were.

    Classes are those of :func:`near_duplicate_classes`.  A class without any id
    keeps the row of the smallest hash.  Of rows with one id and one text any one
    stays; they are brought down to one by each task before they meet.
    """
    classes = near_duplicate_classes(documents, doc_id, text, shingle)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark", "mark2")).alias("k"))
    kept = kept.select(F.col("k.mark").alias("_mark"), F.col("k.mark2").alias("_mark2"))
    row, mark, mark2 = (fresh(documents, n) for n in ("_row", "_m", "_n"))
    keys = identity(doc_id, text)
    marked = documents.select(F.struct(*documents.columns).alias(row), keys[0].alias(mark), keys[1].alias(mark2))
    once = marked.groupBy(mark, mark2).agg(F.first(row).alias(row))
    only = once.join(kept, (F.col(mark) == F.col("_mark")) & (F.col(mark2) == F.col("_mark2")), "left_semi")
    return only.select(*(F.col(row)[c].alias(c) for c in documents.columns))
