"""All pieces of a vocabulary inside many words at once."""

from __future__ import annotations

import numpy as np

#: Between words: a lone surrogate, which neither pieces nor texts of Spark have.
GUARD = "\udc01"
CODE_BITS = 21


class PieceTrie:
    """The pieces as a trie whose edges are one sorted list of (node, character).

    So a step of all walks through it is one search in that list.
    """

    def __init__(self, pieces: list[str]):
        edges: dict[int, int] = {}
        ends: list[int] = [-1]
        for i, piece in enumerate(pieces):
            node = 0
            for code in map(ord, piece):
                key = node << CODE_BITS | code
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = i
        self.keys = np.array(sorted(edges), dtype=np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], dtype=np.int64)
        self.piece = np.array(ends, dtype=np.int64)
        self.sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))

    def inside(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every piece in the words, and where each word begins.

        Positions are those of the joined words; a word's end and the next one's
        beginning are one apart, so they are never the same.
        """
        codes = np.frombuffer((GUARD.join(words) + GUARD).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.cumsum(lengths + 1) - lengths - 1
        start = np.flatnonzero(codes != ord(GUARD))
        node = np.zeros(len(start), np.int64)
        starts, ends, found = [], [], []
        size = 0
        while len(start) and len(self.keys):
            key = node << CODE_BITS | codes[start + size]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = np.flatnonzero(self.keys[at] == key)
            start, node, size = start[on], self.child[at[on]], size + 1
            hit = np.flatnonzero(self.piece[node] >= 0)
            starts.append(start[hit])
            ends.append(start[hit] + size)
            found.append(self.piece[node[hit]])
        none = [np.empty(0, np.int64)]
        return *(np.concatenate(x + none) for x in (starts, ends, found)), begin


def with_unknown(
    start: np.ndarray, end: np.ndarray, piece: np.ndarray, begin: np.ndarray, lengths: np.ndarray, unknown: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same edges, and one of the unknown piece for each character that is no piece."""
    missing = np.ones(int(begin[-1] + lengths[-1]) + 1 if len(begin) else 0, dtype=bool)
    missing[start[end - start == 1]] = False
    missing[begin + lengths] = False
    lone = np.flatnonzero(missing)
    return np.concatenate((start, lone)), np.concatenate((end, lone + 1)), np.concatenate((piece, np.full(len(lone), unknown)))
