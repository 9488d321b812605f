"""Phrases that occur far more often than their parts would by chance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starqa.llm.common import chunks
from starqa.sources.storage import remove, stored

UNDETERMINED = "und"
#: Characters that end a piece; words are what blanks separate within one.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Only ``.`` is left of them, as a token of its own: no word has one.
ONE_BREAK = bytes.maketrans(BREAKS, b"." * len(BREAKS))

#: Phrases have 2 to LONGEST words and occur LEAST times or more; a language's first TOP are given.
LEAST, LONGEST, TOP = 100, 5, 2000
#: A phrase goes if a longer one that contains it has so many hundredths of its occurrences.
INSIDE = 100

#: A tile covers 2^TILE_BITS ranks on either side; with this many pairs in a chunk it is counted densely.
TILE_BITS, DENSE = 10, 1 << 16
#: Bytes of text whose words share one dictionary.
CHUNK = 8 << 20
#: Slices of a language in which its first phrases are sought before they meet.
SLICES = 32
#: Ids of what is too rare, and of breaks.
GAP = -1

#: Pairs that are merged in one task, about: a block of the line of all pairs.
BLOCK = 1 << 20
#: Blocks of words for each shuffle partition.
WORD_BLOCKS = 4
#: Spreads the second halves of pairs over a block's line; odd, so that it can be undone.
SPREAD = 0x9E3779B1

WORDS = "chunk long, lang string, block long, own binary, words binary, times binary, sequence binary"
PAIRS = "chunk long, block long, base long, codes binary, times binary, sequence binary"
FOUND_WORDS = "chunk long, block long, lang string, word string, f long, j long, given binary"
FOUND_PAIRS = "chunk long, block long, a long, b long, f long, j long, given binary"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, kinds[kind]) for (_, kind), c in zip(fields, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in seven bits a byte, the last byte of each below 128, compressed."""
    values = values.astype(np.uint64)
    lengths = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        lengths += values >= np.uint64(1 << bits)
    ends = np.cumsum(lengths)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for i in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > i)
        more = np.where(lengths[on] > i + 1, 128, 0)
        out[ends[on] - lengths[on] + i] = (values[on] >> np.uint64(7 * i) & np.uint64(127)).astype(np.int64) | more
    return compress(out.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    """What ``packed`` was given."""
    raw = np.frombuffer(decompress(data), np.uint8)
    ends = np.flatnonzero(raw < 128) + 1
    lengths = np.diff(ends, prepend=0)
    values = np.zeros(len(ends), np.int64)
    for i in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > i)
        values[on] |= (raw[ends[on] - lengths[on] + i] & 127).astype(np.int64) << (7 * i)
    return values


def _answer(own: np.ndarray, j: np.ndarray, f: np.ndarray, before: np.ndarray) -> bytes:
    """What a block tells a chunk: numbers that frequent symbols have there, and their numbers, frequencies and sums here.

    The latter three rise together, so what is sent of them is small.
    """
    order = np.argsort(j)
    return packed(np.concatenate([*(np.diff(x[order], prepend=0) for x in (j, f, before)), own[order]]))


def _answered(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_answer`` was given, in the order of ``j``."""
    *rising, own = unpacked(data).reshape(4, -1)
    return own, *(np.cumsum(x) for x in rising)


def _slices(data: bytes) -> Iterator[bytes]:
    """The text in slices of about CHUNK bytes, cut at breaks; a piece stays whole."""
    start = 0
    while len(data) - start > CHUNK:
        cut = data.rfind(b".", start, start + CHUNK)
        cut = cut if cut >= 0 else data.find(b".", start + CHUNK)
        if cut < 0:
            break
        yield data[start:cut]
        start = cut + 1
    yield data[start:]


def _word_rows(blocks: int):
    """Function for batches: the words of a chunk and language by block of their hash, and the sequence of their numbers.

    The more frequent a word is in its chunk, the smaller its number; 0 is the
    break in the packed sequence.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for batch in chunks(batches, "text", CHUNK):
            of: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of.setdefault(lang, []).append(text.encode().lower().translate(ONE_BREAK))
            for lang, texts in of.items():
                for data in _slices(b".".join(texts)):
                    # The break comes first, so its number is 0, and -1 when words count from 0.
                    tokens = pa.array([b".", *data.replace(b".", b" . ").split()], pa.binary()).dictionary_encode()
                    words = tokens.dictionary.to_pylist()[1:]
                    if not words:
                        continue
                    ids = tokens.indices.to_numpy()[1:] - 1
                    times = np.bincount(ids[ids >= 0], minlength=len(words))
                    order = np.argsort(-times, kind="stable")
                    own = np.empty(len(words) + 1, np.int64)
                    own[order], own[-1] = np.arange(len(words)), GAP
                    block = np.fromiter(map(crc32, words), np.int64, len(words))[order] % blocks
                    by_block = np.argsort(block, kind="stable")
                    cuts = np.flatnonzero(np.diff(block[by_block], prepend=-1))
                    parts = np.split(by_block, cuts[1:])
                    n = len(parts)
                    yield _batch(WORDS, [
                        [chunk] * (n + 1), [lang] * (n + 1), [*block[by_block[cuts]].tolist(), None],
                        [*(packed(np.diff(x, prepend=0)) for x in parts), None],
                        [*(compress(b" ".join([words[i] for i in order[x]]), 1) for x in parts), None],
                        [*(packed(times[order[x]]) for x in parts), None],
                        [None] * n + [packed(own[ids] + 1)],
                    ])
                    chunk += 1

    return rows


def _word_block(least: int):
    """Function for a block: words of each language in all, the frequent ones, and for each chunk which of its words these are."""

    def rows(key: tuple, parts: pa.Table) -> pa.Table:
        block, out, answers, known, passed = key[0].as_py(), [], [], 0, 0
        langs = np.array(parts.column("lang").to_pylist(), dtype=object)
        chunk, own, words, times = (parts.column(c).to_pylist() for c in ("chunk", "own", "words", "times"))
        for lang in sorted(set(langs)):
            mine = np.flatnonzero(langs == lang)
            listed = [decompress(words[i]).split(b" ") for i in mine]
            tokens = pa.array(chain.from_iterable(listed), pa.binary()).dictionary_encode()
            which = tokens.indices.to_numpy()
            f = np.zeros(len(tokens.dictionary), np.int64)
            np.add.at(f, which, np.concatenate([unpacked(times[i]) for i in mine]))
            place, frequent = _placed(f, least)
            n, some, sums = len(frequent), f[frequent], np.cumsum(f[frequent]) - f[frequent]
            names = tokens.dictionary.take(pa.array(frequent)).cast(pa.string())
            out.append(_batch(FOUND_WORDS, [[None] * n, [block] * n, [lang] * n, names, some, np.arange(known, known + n), [None] * n]))
            out.append(_batch(FOUND_WORDS, [[None], [block], [lang], [None], [int(f.sum())], [None], [None]]))
            j, start = place[which], 0
            for i, x in zip(mine, listed):
                here = j[start : start + len(x)]
                at = np.flatnonzero(here >= 0)
                if len(at):
                    here = here[at]
                    given = _answer(np.cumsum(unpacked(own[i]))[at], here + known, some[here], sums[here] + passed)
                    answers.append((chunk[i], block, None, None, None, None, given))
                start += len(x)
            known, passed = known + n, passed + int(some.sum())
        if answers:
            out.append(_batch(FOUND_WORDS, list(zip(*answers))))
        return pa.Table.from_batches(out)

    return rows


def _placed(f: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol its place among the frequent ones, the rarest first, or GAP; and those, in order."""
    frequent = np.flatnonzero(f >= least)
    frequent = frequent[np.argsort(f[frequent], kind="stable")]
    place = np.full(len(f), GAP, np.int64)
    place[frequent] = np.arange(len(frequent))
    return place, frequent


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (both halves), how often each occurs, and for each given pair its number among them.

    Ranks have 31 bits and split the table of all pairs into tiles.  Where a tile has many pairs
    its cells are addressed directly and counted at once; the pairs of all
    others are sorted.
    """
    side = 1 << TILE_BITS
    tile = (a >> TILE_BITS << 32) | (b >> TILE_BITS)
    tiles, where, size = np.unique(tile, return_inverse=True, return_counts=True)
    number = np.empty(len(a), np.int64)
    codes, times, known = [], [], 0
    for t in np.flatnonzero(size >= DENSE):
        here = np.flatnonzero(where == t)
        cell = ((a[here] & (side - 1)) << TILE_BITS) | (b[here] & (side - 1))
        counted = np.bincount(cell, minlength=side * side)
        full = np.flatnonzero(counted)
        place = np.zeros(side * side, np.int64)
        place[full] = np.arange(known, known + len(full))
        number[here] = place[cell]
        high, low = int(tiles[t]) >> 32 << TILE_BITS, (int(tiles[t]) & 0xFFFFFFFF) << TILE_BITS
        codes.append(((high + (full >> TILE_BITS)) << 32) | (low + (full & (side - 1))))
        times.append(counted[full])
        known += len(full)
    rest = np.flatnonzero(size[where] < DENSE)
    sparse, inverse, counted = np.unique((a[rest] << 32) | b[rest], return_inverse=True, return_counts=True)
    number[rest] = inverse + known
    code = np.concatenate([*codes, sparse])
    return code >> 32, code & 0xFFFFFFFF, np.concatenate([*times, counted]), number


def _line(a: np.ndarray, b: np.ndarray, f: np.ndarray, before: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A pair's code, and its place on a line on which all pairs lie evenly.

    The first half has a stretch of the line as long as it is frequent (``f``,
    after ``before``), the second half a place there by its spread number.  So
    neither a frequent first half nor frequent pairs make one part of the line
    crowded.  Codes rise along the line.
    """
    spread = b * SPREAD & ((1 << bits) - 1)
    return a << bits | spread, before + f * (spread / (1 << bits))


def _pair_rows(bits: int, blocks: int, total: int, starts: dict[int, tuple[int, int]]):
    """Function for a chunk: its sequence and what blocks tell of its symbols give the next sequence and packed pairs by block."""

    def rows(key: tuple, pieces: pa.Table, given: pa.Table) -> pa.Table:
        none = _batch(PAIRS, [[]] * 6)
        ids = unpacked(pieces.column("sequence")[0].as_py()) - 1
        if not given.num_rows:
            return pa.Table.from_batches([none])
        parts = []
        for block, data in zip(given.column("block").to_pylist(), given.column("given").to_pylist()):
            own, j, f, before = _answered(data)
            parts.append((own, j + starts[block][0], f, before + starts[block][1]))
        own, rank, f, before = map(np.concatenate, zip(*parts))
        # The chunk's own symbols, most frequent first, so that those meet in the first tiles.
        order = np.argsort(-f, kind="stable")
        here = np.full(max(int(ids.max(initial=0)), int(own.max())) + 2, GAP, np.int64)
        here[own[order]] = np.arange(len(order))
        rank, f, before = rank[order], f[order], before[order]
        symbols = here[ids]  # GAP is the last entry, which is GAP
        paired = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        if not len(paired):
            return pa.Table.from_batches([none])
        a, b, times, number = tile_counts(symbols[paired], symbols[paired + 1])
        codes, place = _line(rank[a], rank[b], f[a], before[a], bits)
        order = np.argsort(codes)
        codes, times = codes[order], times[order]
        block = np.minimum((place[order] * (blocks / total)).astype(np.int64), blocks - 1)
        final = np.empty(len(order), np.int64)
        final[order] = np.arange(len(order))
        # Between two runs of pairs one gap is enough.
        apart = np.flatnonzero(np.diff(paired) > 1) + 1
        sequence = packed(np.insert(final[number], apart, GAP) + 1)
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        parts = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(block)]))
        chunk, n = key[0].as_py(), len(parts)
        return pa.Table.from_batches([_batch(PAIRS, [
            [chunk] * (n + 1), [*block[cuts].tolist(), None], [*cuts.tolist(), None],
            [*(packed(np.diff(codes[x:y], prepend=0)) for x, y in parts), None],
            [*(packed(times[x:y]) for x, y in parts), None],
            [None] * n + [sequence],
        ])])

    return rows


def _block_rows(bits: int, least: int):
    """Function for a block: its frequent pairs, and for each chunk which of its pairs these are."""
    undo = pow(SPREAD, -1, 1 << bits) if bits else 0

    def rows(key: tuple, parts: pa.Table) -> pa.Table:
        block = key[0].as_py()
        lists = [np.cumsum(unpacked(x)) for x in parts.column("codes").to_pylist()]
        codes, which = np.unique(np.concatenate(lists), return_inverse=True)
        times = np.concatenate([unpacked(x) for x in parts.column("times").to_pylist()])
        f = np.zeros(len(codes), np.int64)
        np.add.at(f, which, times)
        place, frequent = _placed(f, least)
        j = place[which]
        n, some, sums = len(frequent), f[frequent], np.cumsum(f[frequent]) - f[frequent]
        b = (codes[frequent] & ((1 << bits) - 1)) * undo & ((1 << bits) - 1)
        out = [_batch(FOUND_PAIRS, [
            [None] * n, [block] * n, codes[frequent] >> bits, b, some, np.arange(n), [None] * n,
        ])]
        answers, start = [], 0
        for chunk, base, codes_here in zip(parts.column("chunk").to_pylist(), parts.column("base").to_pylist(), lists):
            mine = j[start : start + len(codes_here)]
            start += len(codes_here)
            at = np.flatnonzero(mine >= 0)
            if len(at):
                mine = mine[at]
                answers.append((chunk, block, None, None, None, None, _answer(at + base, mine, some[mine], sums[mine])))
        if answers:
            out.append(_batch(FOUND_PAIRS, list(zip(*answers))))
        return pa.Table.from_batches(out)

    return rows


def block_starts(found: DataFrame) -> tuple[dict[int, tuple[int, int]], int, int]:
    """For each block with frequent symbols, how many come in blocks before it and the sum of their ``f``; then both over all.

    A row per block comes to the driver: one for about BLOCK pairs, or WORD_BLOCKS for a shuffle partition.
    """
    starts, count, total = {}, 0, 0
    for row in found.groupBy("block").agg(F.count("*").alias("n"), F.sum("f").alias("sum")).orderBy("block").collect():
        starts[row["block"]] = count, total
        count, total = count + row["n"], total + row["sum"]
    return starts, count, total


def ranked(found: DataFrame, starts: dict[int, tuple[int, int]]) -> DataFrame:
    """The rows with ``rank``: 0, 1, ... by block, then by number in it."""
    of = found.sparkSession.createDataFrame([(block, first) for block, (first, _) in starts.items()], "block long, first long")
    return found.join(F.broadcast(of), "block").withColumn("rank", F.col("first") + F.col("j")).drop("block", "first", "j")


def _lowest_score(n: Column) -> Column:
    """The lowest floor(1000 * a * n / (l * r)) of a phrase's cuts, with its l and r; ties go to the first cut.

    ``pre`` and ``suf`` have the counts of its first and last 1, 2, ... words.
    A decimal has 38 digits: counts may have 17.
    """
    big = lambda c: c.cast("decimal(19,0)")

    def cut(left: Column, k: Column) -> Column:
        right = F.element_at("suf", F.size("suf") - k - 1)
        whole = (F.lit(1000).cast("decimal(4,0)") * big(F.col("a"))).cast("decimal(23,0)") * big(n)
        score = F.call_function("div", whole.cast("decimal(38,0)"), (big(left) * big(right)).cast("decimal(38,0)"))
        return F.struct(score.cast("long").alias("score"), (k + 1).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.slice("pre", F.lit(1), F.size("pre") - 1), cut))


def collocations(
    documents: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language.

    Texts, A-Z in lower case, are cut into pieces at ``.,;:!?`` and line ends,
    those into words at blanks.  A phrase of 2 to ``longest`` words of one piece
    that occurs ``least`` times or more in its language is a candidate; its
    score is that of its worst cut.  Candidates inside a longer one that is as
    frequent go.  Ties in score go to the more frequent, then to the phrase that
    comes first in byte order.

    A null language is ``und``; null and empty texts have no words; repeated rows
    count each time; other columns are not used.  No texts give no rows.

    Each chunk of texts is written once as numbers of its own dictionary.  Words
    of all dictionaries are counted together, in blocks by hash, frequent ones
    get ranks block by block, and each chunk gets back, packed, only those of its own
    words, so no task sees the whole vocabulary.  Pairs of neighbouring ranks are counted in
    tiles; frequent pairs get ranks and are the next symbols: neighbours that
    overlap in all but one word are a phrase one word longer.

    A chunk's pairs travel as sorted, packed lists, one for each block of a line
    on which all pairs lie evenly; about 2^20 pairs meet in a block, which tells
    each chunk which of its pairs are frequent.  Ranks have 31 bits.  The numbers of
    one length are removed as soon as those of the next are written.
    """
    texts = documents.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    blocks = WORD_BLOCKS * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = stored(texts.mapInArrow(_word_rows(blocks), WORDS), "word-numbers")
    lists = pieces.where(F.col("block").isNotNull()).drop("sequence")
    counted = stored(lists.groupBy("block").applyInArrow(_word_block(least), FOUND_WORDS), "word-counts")
    own_rows = counted.where(F.col("chunk").isNull())
    totals = own_rows.where(F.col("word").isNull()).groupBy("lang").agg(F.sum("f").alias("n"))
    words = own_rows.where(F.col("word").isNotNull()).select("block", "lang", "word", "f", "j")
    starts, symbols, total = block_starts(words)
    known = ranked(words, starts).select(
        "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", "rank",
        F.array("f").alias("pre"), F.array("f").alias("suf"),
    )
    levels: list[DataFrame] = []
    inside: list[DataFrame] = []
    for length in range(2, longest + 1):
        if symbols >= 1 << 31:
            raise ValueError("more frequent phrases than ranks")
        bits, blocks = max(symbols - 1, 0).bit_length(), total // BLOCK + 1
        chunked = pieces.where(F.col("sequence").isNotNull()).select("chunk", "sequence")
        given = counted.where(F.col("chunk").isNotNull()).select(F.col("chunk").alias("of"), "block", "given")
        both = chunked.groupBy("chunk").cogroup(given.groupBy("of"))
        shorter, pieces = pieces, stored(both.applyInArrow(_pair_rows(bits, blocks, max(total, 1), starts), PAIRS), f"pair-numbers-{length}")
        remove(shorter)
        lists = pieces.where(F.col("block").isNotNull()).select("chunk", "block", "base", "codes", "times")
        counted = stored(lists.groupBy("block").applyInArrow(_block_rows(bits, least), FOUND_PAIRS), f"pair-counts-{length}")
        pairs = counted.where(F.col("chunk").isNull()).select("block", "a", "b", "f", "j")
        starts, symbols, total = block_starts(pairs)
        left = known.select(F.col("rank").alias("a"), "lang", "phrase", "pre")
        right = known.select(F.col("rank").alias("b"), "last", "suf")
        named = ranked(pairs, starts).join(left, "a").join(right, "b").select(
            "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a", "b", "f", "rank",
            F.concat("pre", F.array("f")).alias("pre"), F.concat("suf", F.array("f")).alias("suf"),
        )
        named = stored(named, f"phrases-{length}")
        # What contains a phrase and is longer contains one that is longer by one word and no rarer.
        inside.append(named.select(F.col("a").alias("rank"), "f").union(named.select(F.col("b").alias("rank"), "f")))
        known = named.select("lang", "phrase", "last", "f", "rank", "pre", "suf")
        levels.append(known)
    remove(pieces)
    kept = []
    for known, longer in zip(levels, [*inside[1:], None]):
        if longer is not None:
            most = longer.groupBy("rank").agg(F.max("f").alias("longer"))
            known = known.join(most, "rank", "left").where(
                F.col("longer").isNull() | (100 * F.col("longer") < INSIDE * F.col("f"))
            )
        kept.append(known.select("lang", "phrase", F.col("f").alias("a"), "pre", "suf"))
    candidates = reduce(DataFrame.unionAll, kept).join(totals, "lang")
    worst = _lowest_score(F.col("n"))
    scored = candidates.withColumn("worst", worst).select(
        "lang", "phrase", "a", F.col("worst.l").alias("l"), F.col("worst.r").alias("r"), "n", F.col("worst.score").alias("score")
    )
    # A language's phrases are cut down in slices before they meet.
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    sliced = scored.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    near = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*order)))
    last = near.where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return last.where(F.col("rank") <= top).select(*(F.col(c).cast("long") if c == "rank" else F.col(c) for c in names))
