"""Language identification by unigrams of pieces, summed over all segmentations.

A word's probability in a language is the sum, over all ways to cut it into
pieces of a fixed vocabulary, of the product of the pieces' probabilities in
that language; a text's is the product over its words.  The probabilities come
from expected counts over all segmentations of the training texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starqa.llm.common import chunks, fresh, is_training
from starqa.llm.lattice import PieceTrie, with_unknown
from starqa.llm.vocabulary import LITERAL, SPACE, Pieces, load_pieces

UNDETERMINED = "und"
#: Distinct words that a task counts before it turns them into piece counts; words whose likelihoods a worker remembers.
COUNTED, REMEMBERED = 200_000, 350_000
#: Words that are looked at together.
GROUP = 10_000
#: A character's usual share of a logarithm; how far the products of a word may go without leaving a double.
LIFT, FAR = 3.0, 550.0
#: Added to each expected count.
SMOOTHING = 0.05
_LETTER = re.compile(r"[^\W\d_]")


class Lattice:
    """All pieces inside some words, as edges between positions of the joined words.

    A character that is no piece is an edge of the unknown piece, the last id.
    """

    def __init__(self, words: list[bytes], trie: PieceTrie, unknown: int):
        texts = [SPACE + w.decode().replace(SPACE, LITERAL) for w in words]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        start, end, piece, self.begin = trie.inside(texts)
        self.words, self.trie, self.unknown = words, trie, unknown
        self.start, self.end, self.piece = with_unknown(start, end, piece, self.begin, lengths, unknown)
        self.finish, self.lengths = self.begin + lengths, lengths
        self.word = np.repeat(np.arange(len(words)), lengths + 1)[self.start]
        self.positions = int(self.finish[-1]) + 1 if words else 0

    def _steps(self, into: np.ndarray, depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Edges by step of depth, in order of ``into``, and where a new position begins among them."""
        order = np.lexsort((into, depth))
        cuts = np.flatnonzero(np.diff(depth[order], prepend=-1))
        for step in np.split(order, cuts[1:]):
            yield step, np.flatnonzero(np.diff(into[step], prepend=-1))

    def _summed(self, into: np.ndarray, source: np.ndarray, depth: np.ndarray, edge: np.ndarray, from_: np.ndarray) -> np.ndarray:
        """Log sums over paths, one step of depth at a time; ``into`` and ``source`` are positions of edges."""
        total = np.full((self.positions, edge.shape[1]), -np.inf)
        total[from_] = 0.0
        for step, first in self._steps(into, depth):
            value = total[source[step]] + edge[step]
            most = np.maximum.reduceat(value, first, axis=0)
            counts = np.diff(np.append(first, len(step)))
            sums = np.add.reduceat(np.exp(value - np.repeat(most, counts, axis=0)), first, axis=0)
            total[into[step[first]]] = most + np.log(sums)
        return total

    def _products(self, into: np.ndarray, source: np.ndarray, depth: np.ndarray, edge: np.ndarray, from_: np.ndarray) -> np.ndarray:
        """The same sums as plain products."""
        total = np.zeros((self.positions, edge.shape[1]))
        total[from_] = 1.0
        with np.errstate(over="ignore", invalid="ignore"):
            for step, first in self._steps(into, depth):
                total[into[step[first]]] = np.add.reduceat(total[source[step]] * edge[step], first, axis=0)
        return total

    def _lifted(self, log_p: np.ndarray) -> np.ndarray:
        """Each edge's probability, lifted by a constant for each character so that a word's stays near 1."""
        sizes = np.append(self.trie.sizes, 1)[:, None]
        return np.exp(np.minimum(log_p + LIFT * sizes, FAR))[self.piece]

    def _far(self, whole: np.ndarray) -> np.ndarray:
        """Words whose products are beyond what a double can hold well."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.flatnonzero(~(np.abs(np.log(whole)) < FAR).all(axis=1))

    def part(self, words: np.ndarray) -> Lattice:
        return Lattice([self.words[i] for i in words], self.trie, self.unknown)

    def likelihoods(self, log_p: np.ndarray) -> np.ndarray:
        """Log likelihood of each word in each column of ``log_p``."""
        depth = self.end - self.begin[self.word]
        whole = self._products(self.end, self.start, depth, self._lifted(log_p), self.begin)[self.finish]
        far = self._far(whole)
        with np.errstate(divide="ignore", invalid="ignore"):
            found = np.log(whole) - LIFT * self.lengths[:, None]
        if len(far):
            part = self.part(far)
            found[far] = part.forward(log_p[part.piece])[part.finish]
        return found

    def shares(self, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge, the share of its word's probability that goes over it; and words for which that is not known."""
        edge = self._lifted(log_p[:, None])
        forward = self._products(self.end, self.start, self.end - self.begin[self.word], edge, self.begin)
        backward = self._products(self.start, self.end, self.finish[self.word] - self.start, edge, self.finish)
        whole = forward[self.finish]
        far = self._far(whole)
        whole[far] = np.inf
        with np.errstate(over="ignore", invalid="ignore"):
            share = forward[self.start] * edge * backward[self.end] / whole[self.word]
        share[np.isin(self.word, far)] = 0.0
        return share[:, 0], far

    def forward(self, edge: np.ndarray) -> np.ndarray:
        return self._summed(self.end, self.start, self.end - self.begin[self.word], edge, self.begin)

    def backward(self, edge: np.ndarray) -> np.ndarray:
        return self._summed(self.start, self.end, self.finish[self.word] - self.start, edge, self.finish)


def _automaton(pieces: list[str]) -> PieceTrie:
    return PieceTrie(pieces)


def _expected(words: list[bytes], weights: np.ndarray, log_start: np.ndarray, trie: PieceTrie) -> np.ndarray:
    """Expected counts of pieces over all segmentations of the words: one row per column of weights."""
    lattice = Lattice(words, trie, len(log_start) - 1)
    share, far = lattice.shares(log_start)
    total = np.stack([np.bincount(lattice.piece, share * w[lattice.word], len(log_start)) for w in weights.T])
    if len(far):
        part = lattice.part(far)
        edge = log_start[part.piece][:, None]
        forward, backward = part.forward(edge), part.backward(edge)
        share = np.exp(forward[part.start] + edge + backward[part.end] - forward[part.finish][part.word])[:, 0]
        total += np.stack([np.bincount(part.piece, share * w[far][part.word], len(log_start)) for w in weights.T])
    return total


def train(documents: DataFrame, pieces: list[str], text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities, pieces (the last unknown) by languages.

    One pass of expectation over every given text, from a start in which pieces
    are the likelier the earlier they stand in the vocabulary.  What comes to
    the driver is one number per piece and language.
    """
    start = 1.0 / (np.arange(len(pieces) + 1) + 10.0)
    start[-1] = 1e-9
    log_start = np.log(start / start.sum())
    shared = documents.sparkSession.sparkContext.broadcast(pieces)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(shared.value)
        counts: dict[str, Counter] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            words = list(set().union(*counts.values()))
            if words:
                total = 0.0
                for a in range(0, len(words), GROUP):
                    group = words[a : a + GROUP]
                    weights = np.array([[c[w] for c in counts.values()] for w in group], dtype=float)
                    total = total + _expected(group, weights, log_start, automaton)
                for name, row in zip(counts, total, strict=True):
                    at = np.flatnonzero(row)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(row[at])], names=["lang", "piece", "n"]
                    )
            counts.clear()

        for batch in chunks(batches, "text"):
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(name, Counter()).update(value.encode().split())
            if sum(map(len, counts.values())) > COUNTED or len(counts) > 50:
                yield from emit()
        yield from emit()

    rows = (
        documents.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .mapInArrow(each, "lang string, piece int, n double")
        .groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    )
    languages = sorted(rows["lang"].unique())
    table = np.full((len(pieces) + 1, len(languages)), SMOOTHING)
    for column, name in enumerate(languages):
        own = rows[rows["lang"] == name]
        np.add.at(table[:, column], own["piece"].to_numpy(), own["n"].to_numpy())
    return languages, np.log(table / table.sum(axis=0))


class Scorer:
    """Log likelihoods of texts in each language, remembering words."""

    def __init__(self, pieces: list[str], log_p: np.ndarray):
        self.automaton, self.log_p = _automaton(pieces), log_p
        self.place: dict[bytes, int] = {}
        self.values = np.zeros((REMEMBERED, log_p.shape[1]))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """One row per text; words new to all of them are looked at together."""
        lists = [t.encode().split() if t else [] for t in texts]
        coded = pa.array(chain.from_iterable(lists), pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.place]
        if len(self.place) + len(new) > len(self.values):
            new = words
            self.place.clear()
            self.values = np.zeros((max(REMEMBERED, len(new)), self.log_p.shape[1]))
        for a in range(0, len(new), GROUP):
            group = new[a : a + GROUP]
            first = len(self.place)
            self.values[first : first + len(group)] = Lattice(group, self.automaton, len(self.log_p) - 1).likelihoods(self.log_p)
            self.place.update(zip(group, range(first, first + len(group)), strict=True))
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))[coded.indices.to_numpy()]
        ends = np.cumsum([len(x) for x in lists])
        sums = np.concatenate((np.zeros((1, self.values.shape[1])), np.cumsum(self.values[at], axis=0)))
        return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]


def identify(
    documents: DataFrame, held_out: Column | None = None, pieces: Pieces | None = None,
    text: str = "text", lang: str = "lang", into: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """All columns, and ``lang_pred`` and ``score``, the posterior of that language with equal priors.

    Learns from the rows that are not ``held_out`` and have a text and a
    language.  ``und`` with score 0 where the text is null or has no letter, or
    if no language could be learned.  Equal likelihoods go to the first language
    by name.  Where the input has columns of these names (``into``), the new ones
    get underscores.
    """
    spark = documents.sparkSession
    into = tuple(fresh(documents, name) for name in into)
    names = [p for p in (pieces or load_pieces()).ids if len(p) < 64]
    seen = documents if held_out is None else documents.where(~held_out)
    languages, log_p = train(seen, names, text, lang)
    shared = spark.sparkContext.broadcast((names, languages, log_p))

    @F.arrow_udf("pred string, score double")
    def found(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names, languages, log_p = shared.value
        scorer = Scorer(names, log_p)
        for column in columns:
            rows = []
            for batch in chunks([pa.RecordBatch.from_arrays([column], names=["text"])], "text"):
                texts = batch.column(0).to_pylist()
                letters = [bool(languages and t and _LETTER.search(t)) for t in texts]
                if languages:
                    sums = scorer.texts(texts)
                    best = sums.argmax(axis=1)
                    score = 1.0 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                rows += [(languages[best[i]], float(score[i])) if ok else (UNDETERMINED, 0.0) for i, ok in enumerate(letters)]
            yield pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["pred", "score"]
            )

    # Only texts go to Python; as it may give anything, Spark does not compute it twice for a filter.
    both = fresh(documents, "_found")
    scored = documents.withColumn(both, found.asNondeterministic()(F.col(text)))
    return scored.select(*(F.col(c) for c in documents.columns), *(F.col(both)[f].alias(n) for f, n in zip(("pred", "score"), into)))


def held_out_third(doc_id: str = "doc_id") -> Column:
    return ~is_training(F.col(doc_id), 3, 1)
