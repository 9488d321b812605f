"""SentencePiece encoding by streaming Viterbi, and decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from starqa.llm.common import chunks, fresh
from starqa.llm.lattice import PieceTrie, with_unknown
from starqa.llm.vocabulary import LITERAL, SPACE, Pieces, load_pieces

#: Segments up to this long are searched together and remembered; so many of them at most, in each worker.
REMEMBERED_LENGTH, REMEMBERED = 48, 250_000
#: Segments that are searched together; bytes of text whose segments are listed together.
GROUP, CHUNK = 5_000, 1 << 20


class Encoder:
    """The best-scoring segmentation of texts into pieces.

    A text starts with a space; spaces are written as the space sign.  A
    character that is no piece is written as the byte pieces of its UTF-8, and
    so is a space sign that the text has itself, so decoding is exact.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.known = {p: (pieces.scores[p], i) for p, i in pieces.ids.items()}
        self.cache: dict[str, bytes] = {}
        self.trie = PieceTrie(list(pieces.ids))
        self.edge_ids = np.fromiter(pieces.ids.values(), dtype=np.int64, count=len(pieces.ids))
        self.edge_scores = np.array([pieces.scores[p] for p in pieces.ids])
        crossing = any(a != SPACE and b == SPACE for p in pieces.ids for a, b in zip(p, p[1:], strict=False))
        inner = set("".join(p for p in pieces.ids if len(p) > 1))
        lone = "".join(re.escape(c) for c in "\n\r\t" if c not in inner)
        # No piece reaches over these cuts, so every path has a boundary there.
        self.cuts = None if crossing else re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+|[{lone}]" if lone else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def encode(self, text: str | None) -> bytes:
        """Ids as 32-bit integers; none for null and empty texts."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; segments that are new to all of them are searched together.

        A cut is a boundary on which all paths meet, so what lies before it is
        decided there: each segment is committed by itself.  Longer ones go
        through the streaming search and are forgotten with these texts.
        """
        marked = [SPACE + (t.replace(SPACE, LITERAL) if SPACE in t else t).replace(" ", SPACE) if t else "" for t in texts]
        if self.cuts is None:
            return [self._viterbi(t) if t else b"" for t in marked]
        lists = [self.cuts.findall(t) for t in marked]
        new = [s for s in dict.fromkeys(chain.from_iterable(lists)) if s not in self.cache]
        short = [s for s in new if len(s) <= REMEMBERED_LENGTH]
        long = [s for s in new if len(s) > REMEMBERED_LENGTH]
        if len(self.cache) + len(short) > REMEMBERED:
            used = set(chain.from_iterable(lists))
            self.cache = {s: ids for s, ids in self.cache.items() if s in used}
        for a in range(0, len(short), GROUP):
            group = short[a : a + GROUP]
            self.cache.update(zip(group, self._together(group), strict=True))
        self.cache.update((s, self._viterbi(s)) for s in long)
        out = [b"".join(map(self.cache.__getitem__, x)) for x in lists]
        for s in long:
            del self.cache[s]
        return out

    def _together(self, segments: list[str]) -> list[bytes]:
        """The best paths of many short segments, one position of all of them at a time.

        Of equal paths the one with the longer last piece stays, as in ``_viterbi``.
        """
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        start, end, piece, begin = self.trie.inside(segments)
        start, end, piece = with_unknown(start, end, piece, begin, lengths, len(self.edge_ids))
        word = np.repeat(np.arange(len(segments)), lengths + 1)[start]
        order = np.lexsort((start, end, end - begin[word]))
        start, end, piece, depth = start[order], end[order], piece[order], (end - begin[word])[order]
        score = np.append(self.edge_scores, self.pieces.unknown_score)[piece]
        best = np.zeros(int((begin + lengths).max()) + 1)
        back = np.zeros(len(best), np.int64)
        cuts = np.flatnonzero(np.diff(depth, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(depth)), strict=True):
            value = best[start[a:b]] + score[a:b]
            first = np.flatnonzero(np.diff(end[a:b], prepend=-1))
            most = np.maximum.reduceat(value, first)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
            hit = np.flatnonzero(value == most[group])
            hit = hit[np.diff(group[hit], prepend=-1) != 0]
            best[end[a:b][first]], back[end[a:b][first]] = most, a + hit
        # From the ends back, one piece of every segment at a time.
        at, left = begin + lengths, np.arange(len(segments))
        owners, chosen = [], []
        while len(left):
            edge = back[at]
            owners.append(left)
            chosen.append(piece[edge])
            at = start[edge]
            on = at > begin[left]
            at, left = at[on], left[on]
        owner, number = np.concatenate(owners[::-1]), np.concatenate(chosen[::-1])
        order = np.argsort(owner, kind="stable")
        ids = np.append(self.edge_ids, -1)[number[order]].astype(np.int32)
        ends = np.cumsum(np.bincount(owner, minlength=len(segments)))
        data, ends4 = ids.tobytes(), (4 * ends).tolist()
        out = [data[a:b] for a, b in zip([0, *ends4[:-1]], ends4, strict=True)]
        for strange in set(owner[order][ids < 0].tolist()):
            out[strange] = self._viterbi(segments[strange])
        return out

    def _viterbi(self, text: str) -> bytes:
        """Streaming: paths are kept only since the last boundary that all surviving ones share.

        ``best`` has, for each later position, the best score up to there, the
        boundary before it and the piece between.  Only the last ``longest``
        positions can still be extended; if the paths back from all of them
        meet, everything before is decided and leaves the memory.
        """
        known, longest, n = self.known, self.pieces.longest, len(text)
        unknown = self.pieces.unknown_score
        out = array("i")
        done, check = 0, 2 * longest
        best: dict[int, tuple[float, int, int]] = {0: (0.0, 0, -1)}
        for start in range(n):
            score = best[start][0]
            for end in range(start + 1, min(n, start + longest) + 1):
                found = known.get(text[start:end])
                if found is None:
                    if end > start + 1:
                        continue
                    found = (unknown, -1)
                total = score + found[0]
                old = best.get(end)
                if old is None or total > old[0]:
                    best[end] = (total, start, found[1])
            if start - done >= check:
                alive = {p for p in range(start + 1, min(n, start + longest) + 1) if p in best}
                while len(alive) > 1:
                    last = max(alive)
                    alive.remove(last)
                    alive.add(best[last][1])
                meet = alive.pop()
                if meet > done:
                    self._commit(text, best, done, meet, out)
                    base = best[meet][0]
                    best = {p: (s - base, b, i) for p, (s, b, i) in best.items() if p >= meet}
                    done, check = meet, 2 * longest
                else:
                    check += longest
        self._commit(text, best, done, n, out)
        return out.tobytes()

    def _commit(self, text: str, best: dict[int, tuple[float, int, int]], start: int, end: int, out: array) -> None:
        path = []
        while end > start:
            _, before, i = best[end]
            path.append((before, i))
            end = before
        for before, i in reversed(path):
            if i >= 0:
                out.append(i)
            else:
                character = SPACE if text[before] == LITERAL else text[before]
                out.extend(self.pieces.bytes_[b] for b in character.encode())


def decode(ids: list[int] | np.ndarray, raw: list[bytes]) -> str:
    """The text that was encoded: pieces joined, without the space put first; control ids stand for nothing."""
    whole = b"".join([raw[i] for i in ids])
    return whole.removeprefix(b" ").decode("utf-8", "replace")


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))


def encode_texts(documents: DataFrame, pieces: Pieces | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """All columns, and the ids of each text as an array (empty for null and empty texts).

    If the input has a column named ``into``, the new one gets underscores.
    """
    shared = documents.sparkSession.sparkContext.broadcast(pieces or load_pieces())
    into = fresh(documents, into)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in chunks(batches, text, CHUNK):
            ids = encoder.encode_all(batch.column(batch.schema.get_field_index(text)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(ids)], names=[*batch.schema.names, into])

    return documents.mapInArrow(each, T.StructType([*documents.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]))


def decode_ids(encoded: DataFrame, pieces: Pieces | None = None, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """All columns, and the text that each array of ids stands for (null for a null array)."""
    shared = encoded.sparkSession.sparkContext.broadcast((pieces or load_pieces()).raw)
    into = fresh(encoded, into)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                column = some.column(some.schema.get_field_index(ids))
                texts = [decode(x.values.to_numpy().tolist(), raw) if x.is_valid else None for x in column]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*some.schema.names, into])

    return encoded.mapInArrow(each, T.StructType([*encoded.schema.fields, T.StructField(into, T.StringType())]))
