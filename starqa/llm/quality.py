"""Quality rules: base counts of a text, and its divergence from language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starqa.llm.common import chunks

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Common words of a language; distinct words that a task counts before it hands them on.
COMMON, COUNTED = 64, 200_000
#: Below so many characters, or words, a histogram is too small to judge by.
MIN_CHARS, MIN_JUDGED_WORDS = 200, 50
#: Jensen-Shannon distances (base 2, from 0 to 1) above which a text is turned away.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.30, 0.48
#: What a long text may differ from a language by, and what sampling adds to it, by 1 / sqrt(words).
WORD_DISTANCE, WORD_NOISE = 0.26, 1.8
CLASSES = 8


def _class_table() -> np.ndarray:
    """Of each code point below 2^16 its class, by rule; all above are letters of neither case.

    0 lower case, 1 upper case, 2 other letters, 3 digits, 4 blanks, 5 line
    ends, 6 punctuation and the rest, 7 symbols.
    """

    def kind(c: str) -> int:
        if c in SYMBOLS:
            return 7
        if c in "\n\r":
            return 5
        tests = ((str.islower, 0), (str.isupper, 1), (str.isalpha, 2), (str.isdigit, 3), (str.isspace, 4))
        return next((k for test, k in tests if test(c)), 6)

    return np.array([kind(chr(i)) for i in range(1 << 16)], dtype=np.int8)


_TABLE: list[np.ndarray] = []


def char_classes(text: str) -> np.ndarray:
    """How many characters of a text are in each class."""
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    high = points >= 1 << 16
    counts = np.bincount(_TABLE[0][points[~high]], minlength=CLASSES)
    counts[2] += int(high.sum())
    return counts


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: the root of the divergence, base 2."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0.0).sum() + np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(parts / 2, 0.0)))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines, words in repeated windows of three."""
    in_words = sum(len(w) for w in words) if text.isascii() else sum(len(w.decode()) for w in words)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip("\t\n\v\f\r ")]
    windows = list(zip(words, islice(words, 1, None), islice(words, 2, None), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        repeated = sum(covered)
    return in_words, symbols, len(lines) - len(set(lines)), repeated


def references(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, dict[bytes, float]]]:
    """Of each language its character classes and its COMMON most frequent words with their shares.

    All texts that name a language count, whole.  What comes to the driver is
    COMMON words and CLASSES numbers per language.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            rows = [(name, 0, w, n) for name, c in counts.items() for w, n in c.items()]
            rows += [(name, 1, str(i).encode(), int(n)) for name, c in classes.items() for i, n in enumerate(c)]
            counts.clear()
            classes.clear()
            for a in range(0, len(rows), 50_000):
                name, kind, key, n = zip(*rows[a : a + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name, pa.string()), pa.array(kind, pa.int32()), pa.array(key, pa.binary()), pa.array(n, pa.int64())],
                    names=["lang", "kind", "key", "n"],
                )

        for batch in chunks(batches, "text"):
            for value, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(name, Counter()).update(value.encode().split())
                classes[name] = classes.get(name, 0) + char_classes(value)
            if sum(map(len, counts.values())) > COUNTED:
                yield from emit()
        yield from emit()

    rows = (
        documents.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .mapInArrow(each, "lang string, kind int, key binary, n long")
        .groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key")
    top = rows.withColumn("place", F.row_number().over(order)).where(f"place <= {COMMON}")
    totals = rows.where("kind = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    words = {r["lang"]: r["n"] for r in totals.collect()}
    out: dict[str, tuple[np.ndarray, dict[bytes, float]]] = {}
    for r in top.collect():
        classes, common = out.setdefault(r["lang"], (np.zeros(CLASSES), {}))
        if r["kind"]:
            classes[int(bytes(r["key"]))] = r["n"]
        else:
            common[bytes(r["key"])] = r["n"] / words[r["lang"]]
    return {name: x for name, x in out.items() if x[0].sum() and x[1]}


def word_bound(words: int) -> float:
    """The largest distance by common words of a text with so many words.

    A histogram of few words is far from its source by chance alone, one of many
    is not: without any common word a text is at about 0.41, whatever its length.
    """
    return min(MAX_WORD_DISTANCE, WORD_DISTANCE + WORD_NOISE / max(words, 1) ** 0.5)


class Judge:
    """Distances of texts to the nearest language reference."""

    def __init__(self, known: dict[str, tuple[np.ndarray, dict[bytes, float]]]):
        self.classes = [c for c, _ in known.values()]
        self.place = {w: i for i, w in enumerate(sorted(set().union(*(c for _, c in known.values()))))}
        self.words = []
        for _, common in known.values():
            shares = np.zeros(len(self.place) + 1)
            for w, share in common.items():
                shares[self.place[w]] = share
            shares[-1] = max(1.0 - shares.sum(), 0.0)  # all other words
            self.words.append(shares)

    def distances(self, text: str, words: list[bytes]) -> tuple[float | None, float | None]:
        """Of character classes and of common words; null where the text is too short or nothing is known."""
        by_char = by_word = None
        if self.classes and len(text) >= MIN_CHARS:
            counts = char_classes(text)
            by_char = min(distance(counts, c) for c in self.classes)
        if self.words and len(words) >= MIN_JUDGED_WORDS:
            rest = len(self.place)
            counts = np.bincount([self.place.get(w, rest) for w in words], minlength=rest + 1)
            by_word = min(distance(counts, c) for c in self.words)
        return by_char, by_word


RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, char_distance double, word_distance double"
)


def rate(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``kept`` and both distances of every document.

    A text is kept unless it has under 50 words, or over half of its words are
    in repeated windows of three, or it is farther from every language
    reference than MAX_CHAR_DISTANCE by character classes or ``word_bound`` of
    its number of words by common words.  A histogram of fewer than MIN_CHARS characters or
    MIN_JUDGED_WORDS words turns nothing away, nor does any if no text names a
    language.  Null texts count as empty; repeated rows are rated each; other
    columns are not used.
    """
    shared = documents.sparkSession.sparkContext.broadcast(references(documents, text, lang))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in chunks(batches, "text"):
            found = []
            for value in batch.column(1).to_pylist():
                value = value or ""
                words = value.encode().split()
                counts = base_counts(value, words)
                failed = len(words) < MIN_WORDS or 100 * counts[3] > MAX_REPEAT_PERCENT * len(words)
                by_char, by_word = judge.distances(value, words)
                fits = (by_char or 0.0) <= MAX_CHAR_DISTANCE and (by_word or 0.0) <= word_bound(len(words))
                found.append((len(words), *counts, failed, not failed and fits, by_char, by_word))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64(), pa.float64()]
            columns = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", *(f.split()[0] for f in RESULT.split(", "))],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"doc_id {kind}, {RESULT}")
