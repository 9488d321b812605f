"""Removing passages of words that occur more than once in a corpus.

A count-min sketch of all windows comes first: every partition counts its own
windows, the partial sketches are merged, and what stays is one bit per cell,
whether it was hit twice or more.  A window of which each row's cell says so may
be repeated; all others cannot be.  Only those are then grouped exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starqa.llm.common import fresh

WINDOW = 35
#: Rows of the sketch; cells of a block; cells of the whole sketch at most.
ROWS, BLOCK_CELLS, MAX_CELLS = 2, 1 << 18, 1 << 30
#: Cells that a task gathers before it hands them on; bytes of text worked on together.
GATHERED, CHUNK = 1 << 21, 1 << 18
_GOLDEN = 0x9E3779B97F4A7C15
_WORD_BASE, _BYTE_BASE = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    if base not in kept or len(kept[base]) < n:
        steps = np.full(max(n, CHUNK), base, dtype=np.uint64)
        steps[0] = 1
        kept[base] = np.cumprod(steps)
    return kept[base][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _rolled(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of values, equal for ranges of equal values."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n), out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), n + 1)
    return (sums[ends] - sums[starts]) * back[starts]


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))


class Windows:
    """The windows of some texts.

    ``joined`` has each text's words, joined by spaces, a line per text;
    ``starts`` and ``ends`` of every word in it; ``first`` and ``n`` the words
    of each text; ``at`` the first word of every window, ``hashes`` its hash.
    """

    def __init__(self, texts: list[str | None], window: int):
        lines = [b" ".join(t.encode().split()) if t else b"" for t in texts]
        self.joined = b"\n".join(lines) + b"\n"
        raw = np.frombuffer(self.joined, dtype=np.uint8)
        stops = np.flatnonzero((raw == 32) | (raw == 10))
        begins = np.concatenate(([0], stops[:-1] + 1))
        filled = stops > begins  # a text without words is an empty line
        self.starts, self.ends = begins[filled], stops[filled]
        line_ends = np.cumsum([len(x) + 1 for x in lines])
        upto = np.searchsorted(self.starts, line_ends)
        self.first = np.concatenate(([0], upto[:-1])).astype(np.int64)
        self.n = np.diff(np.concatenate(([0], upto)))
        words = _mixed(_rolled(_BYTES[raw], _BYTE_BASE, self.starts, self.ends)) if len(self.starts) else np.zeros(0, np.uint64)
        counts = np.maximum(self.n - window + 1, 0)
        self.owner = np.repeat(np.arange(len(texts)), counts)
        self.offset = np.arange(len(self.owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.at = self.first[self.owner] + self.offset
        self.hashes = _mixed(_rolled(words, _WORD_BASE, self.at, self.at + window)) if len(self.at) else np.zeros(0, np.uint64)

    def cells(self, row_cells: int) -> list[np.ndarray]:
        """A cell for each row of the sketch, from one half of the hash each."""
        low = np.uint64(0xFFFFFFFF)
        halves = (self.hashes >> np.uint64(32), self.hashes & low)
        return [(h * np.uint64(row_cells) >> np.uint64(32)).astype(np.int64) + i * row_cells for i, h in enumerate(halves)]


def _groups(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    from starqa.llm.common import chunks

    for batch in chunks(batches, text, CHUNK):
        yield batch, batch.column(batch.schema.get_field_index(text)).to_pylist()


def _packed(cells: np.ndarray) -> bytes:
    """Sorted cells of a block as differences, low bytes first, compressed; nothing for none."""
    if not len(cells):
        return b""
    steps = np.diff(cells, prepend=0).astype("<u4")
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.int64)
    steps = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel().astype(np.int64))


def _partial_sketch(row_cells: int, window: int, text: str):
    """Per block of cells: those hit in this partition once, and those hit twice or more."""

    def emit(gathered: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        cells = np.concatenate(gathered)
        cells.sort()
        new = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        often = np.diff(np.append(new, len(cells))) > 1
        cells = cells[new].astype(np.int64)
        edges = np.arange(cells[0] // BLOCK_CELLS, cells[-1] // BLOCK_CELLS + 2)
        cuts = np.searchsorted(cells, edges * BLOCK_CELLS)
        blocks, once, twice = [], [], []
        for block, a, b in zip(edges.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b > a:
                inner, many = cells[a:b] - block * BLOCK_CELLS, often[a:b]
                blocks.append(block)
                once.append(_packed(inner[~many]))
                twice.append(_packed(inner[many]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
            names=["block", "once", "twice"],
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, size = [], 0
        for _, texts in _groups(batches, text):
            for cells in Windows(texts, window).cells(row_cells):
                if len(cells):
                    gathered.append(cells.astype(np.uint32))
                    size += len(cells)
            if size >= GATHERED:
                yield from emit(gathered)
                gathered, size = [], 0
        if gathered:
            yield from emit(gathered)

    return each


def _merged_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the blocks of this partition: one bit per cell, whether it was hit twice or more in all."""
    hits: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = hits.setdefault(block, np.zeros(BLOCK_CELLS, np.uint8))
            single = _unpacked(once)
            own[single] = np.minimum(own[single] + 1, 2)
            own[_unpacked(twice)] = 2
    blocks = sorted(hits)
    for at in range(0, len(blocks), 64):
        some = blocks[at : at + 64]
        bits = [zstandard.compress(np.packbits(hits[b] > 1).tobytes(), 1) for b in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(bits, pa.binary())], names=["block", "bits"])


class Sketch:
    """The merged sketch, as broadcast: compressed bits by block; unpacked once in each worker."""

    def __init__(self, blocks: dict[int, bytes], row_cells: int):
        self.blocks, self.row_cells, self.key = blocks, row_cells, hashlib.sha256(repr(sorted(blocks.items())).encode()).hexdigest()

    def bits(self, kept: dict[str, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
        if self.key not in kept:
            kept.clear()
            whole = np.zeros(-(-ROWS * self.row_cells // BLOCK_CELLS) * (BLOCK_CELLS // 8), dtype=np.uint8)
            for block, data in self.blocks.items():
                at = block * (BLOCK_CELLS // 8)
                whole[at : at + BLOCK_CELLS // 8] = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
            kept[self.key] = whole
        return kept[self.key]

    def maybe_repeated(self, windows: Windows) -> np.ndarray:
        """Indexes of the windows whose every estimate is two or more."""
        bits, alive = self.bits(), np.arange(len(windows.hashes))
        for cells in windows.cells(self.row_cells):
            own = cells[alive]
            alive = alive[bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8) & 1 == 1]
        return alive


def window_sketch(texts: DataFrame, text: str, window: int) -> Sketch:
    """Counts of all windows of all texts, as far as one or more.

    A cell per byte of text, at most MAX_CELLS: that bounds what is collected
    and broadcast to MAX_CELLS / 8 bytes.  Above it the sketch lets more windows
    through and the exact step has more to group; results are the same.
    """
    size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    row_cells = max(BLOCK_CELLS, min(int(size), MAX_CELLS) // ROWS)
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = (
        texts.select(text)
        .mapInArrow(_partial_sketch(row_cells, window, text), "block long, once binary, twice binary")
        .repartition(parts, "block")
        .mapInArrow(_merged_sketch, "block long, bits binary")
    )
    return Sketch({r["block"]: bytes(r["bits"]) for r in merged.collect()}, row_cells)


def _mark(text: str) -> Column:
    """31 bits of hash that tell texts of one id apart."""
    return F.hash(text).bitwiseAND(F.lit(0x7FFFFFFF))


def remove_repeats(
    documents: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", layout: bool = False
) -> DataFrame:
    """All columns of every document, and ``n_words``, ``n_removed``, ``kept_text``.

    A word is removed if it is covered by a window of ``window`` consecutive
    words whose sequence of words starts anywhere else too, in this or another
    document; windows are judged on the input.  ``kept_text`` has the other
    words joined by one space; with ``layout``, each with the white space
    before it, and texts that lose nothing as they are.

    Null and empty texts have no words; repeated rows repeat each other's
    windows; the order of words is all that counts, not the white space.  Where
    the input has columns of these names, the new ones get underscores.

    Exact grouping compares 96 bits of a hash of the window's words.  It looks
    for windows that are estimated repeated but occur once: such a group has
    one row, so it is known where it is from its least id and place, and no
    group is gathered however many copies it has.  Those places go back to
    their document, and whatever else was estimated repeated is repeated.
    """
    spark = documents.sparkSession
    slim = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketch = spark.sparkContext.broadcast(window_sketch(slim, "text", window))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, "text"):
            w = Windows(texts, window)
            alive = sketch.value.maybe_repeated(w)
            if not len(alive):
                continue
            digest, joined = xxhash.xxh3_128_digest, memoryview(w.joined)
            starts = w.starts[w.at[alive]].tolist()
            ends = w.ends[w.at[alive] + window - 1].tolist()
            keys = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(starts, ends, strict=True)]), dtype="<i4").reshape(-1, 4)
            owner = pa.array(w.owner[alive])
            marks = batch.column(2).take(owner).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(keys[:, :2]).view("<i8").ravel()),
                    pa.array(keys[:, 2].astype(np.int32)),
                    batch.column(0).take(owner),
                    pa.array(w.offset[alive] << 32 | marks),
                ],
                names=["k1", "k2", "doc_id", "place"],
            )

    marked = slim.withColumn("mark", _mark("text"))
    alone = (
        marked.mapInArrow(candidates, f"k1 long, k2 int, doc_id {kind}, place long")
        .groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("single_id"), F.min("place").alias("place"))
        .where("n = 1")
        .groupBy("single_id", F.col("place").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("single_mark"))
        .agg(F.collect_list(F.shiftright("place", 32).cast("int")).alias("singles"))
    )

    names = {n: fresh(documents, n) for n in ("n_words", "n_removed", "kept_text", "mark", "singles", "single_id", "single_mark")}
    alone = alone.select(*(F.col(n).alias(names[n]) for n in ("single_id", "single_mark", "singles")))
    rows = documents.withColumn(names["mark"], _mark(text))
    same = F.col(doc_id).eqNullSafe(F.col(names["single_id"])) & (F.col(names["mark"]) == F.col(names["single_mark"]))
    joined = rows.join(alone, same, "left").select(*documents.columns, names["singles"])
    schema = T.StructType([
        *documents.schema.fields,
        T.StructField(names["n_words"], T.LongType()),
        T.StructField(names["n_removed"], T.LongType()),
        T.StructField(names["kept_text"], T.StringType()),
    ])
    with_space = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, text):
            w = Windows(texts, window)
            alive = sketch.value.maybe_repeated(w)
            singles = batch.column(batch.num_columns - 1)
            sizes = [len(s) if s.is_valid else 0 for s in singles]
            lone = np.repeat(w.first, sizes) + singles.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.setdiff1d(w.at[alive], lone, assume_unique=True)
            steps = np.zeros(len(w.starts) + 1, dtype=np.int32)
            steps[begins] += 1
            np.add.at(steps, begins + window, -1)
            stays = np.cumsum(steps[:-1]) == 0
            removed, kept = [], []
            for value, first, n in zip(texts, w.first.tolist(), w.n.tolist(), strict=True):
                own = stays[first : first + n]
                gone = n - int(own.sum())
                removed.append(gone)
                if layout and not gone:
                    kept.append(value)
                    continue
                raw = (value or "").encode()
                words = with_space.findall(raw) if layout else raw.split()
                kept.append((b"" if layout else b" ").join(compress(words, own.tolist()) if gone else words).decode())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(w.n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=schema.names,
            )

    return joined.mapInArrow(remove, schema)
