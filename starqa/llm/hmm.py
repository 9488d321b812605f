"""Scoring texts with a hidden Markov language model.

The states emit classes of tokens: each of the most frequent words is a class of
its own, so is the end of a text, and all other words fall into classes by their
last two bytes.  Within such a class a word has its share of the class's
training tokens, plus one, with one more for unknown words.  So a text's
probability is exact, whatever words it has.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starqa.llm.common import chunks
from starqa.sources.storage import stored

STATES, ROUNDS = 8, 1
#: Words with a class of their own; words whose counts are broadcast; classes of the others.  All classes fit in 16 bits.
OWN_CLASS, HEAD, SUFFIXES = 1 << 15, 1 << 18, 256
#: Rounds of the mixture over all training texts that the start values come from.
START_ROUNDS = 15
#: Weight of even moves in start and transitions.
EVEN = 1.0
CHUNK, COUNTED = 2 << 20, 200_000
#: Steps through texts after which values are scaled anew; in between they shrink, far from what a float cannot hold.
SCALED = 4
#: Rounds have converged when one raises the log likelihood by no more than this share.
CONVERGED = 1e-3
#: Stored classes have two bytes a token, texts about six; twice as many tokens move together while training, so there are fewer steps.
CODED_CHUNK = 2 * CHUNK // 3
#: The most that one entry of a bag counts; classes whose sums travel in one row.
MOST, SUM_ROWS = (1 << 16) - 1, 64


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case; the end is not among them."""
    return text.encode().lower().split() if text else []


def listed(values: pa.Array) -> list[bytes]:
    """Words or classes as bytes."""
    return values.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % SUFFIXES


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What ``tokens`` gives for each text, as numbers: distinct words, all numbers one after the other, and how many each text has.

    The end comes after each text's words; its number is the one after all words.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    found = split.flatten().dictionary_encode()
    lengths, ids = pc.list_value_length(split).to_numpy(), found.indices.to_numpy()
    # Blanks at either side of a text leave an empty word.
    full = pc.not_equal(found.dictionary, "").to_numpy(zero_copy_only=False)
    if not full.all():
        kept = full[ids]
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[kept], minlength=len(lengths))
        ids = (np.cumsum(full) - 1)[ids[kept]]
    words = found.dictionary.filter(pa.array(full))
    return words, np.insert(ids, np.cumsum(lengths), len(words)), lengths + 1


@dataclass(frozen=True)
class Vocabulary:
    """``ranks`` of the head words and their ``counts``, most frequent first; totals of training; sizes of the suffix classes.

    The first ``own`` words have a class of their own.  Classes: suffix classes
    first, then the end, then those words.
    """

    ranks: dict[bytes, int]
    counts: np.ndarray
    own: int
    total: int
    distinct: int
    ends: int
    suffix_tokens: np.ndarray
    suffix_words: np.ndarray

    @property
    def size(self) -> int:
        return SUFFIXES + 1 + self.own

    def class_tokens(self) -> np.ndarray:
        return np.concatenate((self.suffix_tokens, [self.ends], self.counts[: self.own]))

    def ranks_of(self, words: list[bytes]) -> np.ndarray:
        """Ranks of words, -1 for those outside the head."""
        return np.fromiter(map(self.ranks.get, words, repeat(-1)), np.int64, len(words))

    def classes(self, words: list[bytes], ranks: np.ndarray | None = None) -> np.ndarray:
        """Classes of a text's tokens, the end included."""
        ranks = self.ranks_of(words) if ranks is None else ranks
        out = np.append(ranks + SUFFIXES + 1, SUFFIXES)
        others = np.flatnonzero((ranks < 0) | (ranks >= self.own))
        out[others] = [suffix_class(words[i]) for i in others.tolist()]
        return out


def count_words(texts: DataFrame) -> DataFrame:
    """``word``, ``suffix`` and ``n`` of the words in column ``text``, over all rows."""

    def rows(counts: pa.Table) -> Iterator[pa.RecordBatch]:
        suffix = pa.array([suffix_class(w) for w in listed(counts.column("word"))], pa.int32())
        yield from pa.table({"word": counts.column("word"), "suffix": suffix, "n": counts.column("n")}).to_batches(50_000)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in chunks(batches, "text"):
            words, ids, _ = numbered(batch.column(0))
            here = pa.table({"word": words, "n": np.bincount(ids, minlength=len(words) + 1)[:-1]})
            counts = pa.concat_tables([counts, here]).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])
            if len(counts) > COUNTED:
                yield from rows(counts)
                counts = counts.slice(0, 0)
        yield from rows(counts)

    return texts.select("text").mapInArrow(each, "word string, suffix int, n long").groupBy("word", "suffix").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame, ends: int) -> Vocabulary:
    """What scoring needs of the counts, bounded by HEAD words; the rest stays a table."""
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The least count such that at most HEAD words have it or more, from how many words have each count.
    upto = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    kept = words.groupBy("n").count().withColumn("upto", F.sum("count").over(upto)).where(F.col("upto") <= HEAD)
    least = kept.agg(F.min("n")).first()[0]
    head = [] if least is None else words.where(F.col("n") >= least).select("word", "n").toPandas()
    if len(head):
        head = head.sort_values(["n", "word"], ascending=[False, True])
        ranks = {w.encode(): i for i, w in enumerate(head["word"])}
        counts = head["n"].to_numpy(dtype=np.int64)
    else:
        ranks, counts = {}, np.zeros(0, dtype=np.int64)
    own = min(OWN_CLASS, len(counts))
    tokens_, words_ = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in words.groupBy("suffix").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        tokens_[r["suffix"]], words_[r["suffix"]] = r["n"], r["words"]
    for w, n in zip(list(ranks)[:own], counts.tolist()):  # words of their own class are in no other
        tokens_[suffix_class(w)] -= n
        words_[suffix_class(w)] -= 1
    return Vocabulary(ranks, counts, own, int(total) + ends, int(distinct) + (ends > 0), ends, tokens_, words_)


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes by states


def estimate(start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_tokens: np.ndarray) -> Model:
    """A model from expected counts; emissions lean towards the shares over all states.

    They do so with a weight of one for each class that a state emits (as far
    as it is expected to): a state that goes on meeting new words leans more.
    """
    share = (class_tokens + 1) / (class_tokens + 1).sum()
    emit = emit + (np.minimum(emit, 1).sum(axis=0) + 1) * share[:, None]
    start, move = start + EVEN, move + EVEN
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Sequences:
    """Texts of one chunk, longest first, laid out step by step, so that all move together."""

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        steps = np.arange(sizes[0])
        self.active = np.searchsorted(-sizes, -steps, side="left")  # how many texts are longer than each step
        self.first = np.concatenate(([0], np.cumsum(self.active)))
        self.last = self.first[sizes - 1] + np.arange(len(sizes))
        flat = np.concatenate([np.asarray(texts[i], dtype=np.int64) for i in self.order])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        rank = np.repeat(np.arange(len(sizes)), sizes)
        self.classes = np.empty(len(flat), dtype=np.int64)
        self.classes[self.first[step] + rank] = flat

    def forward(self, model: Model, emitted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None], np.ndarray]:
        """Log likelihoods of the texts, in their order given; scaled values of all tokens, scales of all steps, and what they leave of each text's last token.

        ``emitted``, what each state emits of each token, is written over.
        """
        values = self.emitted(model) if emitted is None else emitted
        every, logs, scales = np.ones(len(model.start)), np.zeros(len(self.order)), []
        values[: self.active[0]] *= model.start
        before = None
        for step, (at, n) in enumerate(zip(self.first.tolist(), self.active.tolist()), 1):
            here, scale = values[at : at + n], None
            if before is not None:
                here *= before[:n] @ model.move
            if step % SCALED == 0:
                scale = here @ every
                here /= scale[:, None]
                logs[:n] += np.log(scale)
            scales.append(scale)
            before = here
        left = values[self.last] @ every
        out = np.empty(len(self.order))
        out[self.order] = logs + np.log(left)
        return out, values, scales, left

    def emitted(self, model: Model) -> np.ndarray:
        return model.emit.take(self.classes, axis=0, mode="clip")

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts over all paths: first states, moves, and classes by states; and the texts' log likelihood."""
        later = self.emitted(model)  # of each token: what it and all after it emit, scaled
        logs, values, scales, left = self.forward(model, later.copy())
        later[self.last] /= left[:, None]
        back, after = np.ascontiguousarray(model.move.T), later[:0]
        for at, n, scale in zip(self.first[-2::-1].tolist(), self.active[::-1].tolist(), reversed(scales)):
            here = later[at : at + n]
            here[: len(after)] *= after @ back
            if scale is not None:
                here /= scale[:, None]
            after = here
        # A token's predecessor lies as many places before it as texts are active one step earlier.
        rest = later[self.active[0] :]
        earlier = np.arange(self.active[0], len(later)) - np.repeat(self.active[:-1], self.active[1:])
        seen = values[earlier]
        moves = seen.T @ rest
        seen *= rest @ back
        values[earlier] = seen
        values[self.last] /= left[:, None]
        emit = np.stack([np.bincount(self.classes, w, len(model.emit)) for w in values.T], axis=1)
        return values[: self.active[0]].sum(axis=0), moves * model.move, emit, float(logs.sum())


def mark(classes: np.ndarray) -> int:
    """A hash of a text's classes."""
    return zlib.crc32(classes.astype("<i4").tobytes())


def bags(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct classes of each text with how often they occur there (above 16 bits), one text after the other, and how many each has.

    A class that occurs more than MOST times has several entries.
    """
    keys, times = np.unique(np.repeat(np.arange(len(lengths)) << 16, lengths) | flat, return_counts=True)
    parts = -(-times // MOST)
    first = np.cumsum(parts) - parts
    keys, rest = np.repeat(keys, parts), times - (parts - 1) * MOST
    times = np.full(len(keys), MOST)
    times[first] = rest
    return (keys & 0xFFFF | times << 16).astype("<u4"), np.bincount(keys >> 16, minlength=len(lengths))


def first_shares(marks: np.ndarray, states: int, seed: int = 42) -> np.ndarray:
    """Even (Dirichlet) shares of the states in each text, fixed by its mark: equal wherever the text lies."""
    x = (marks.astype(np.uint64)[:, None] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    share = -np.log(((x >> np.uint64(11)).astype(float) + 0.5) / 2.0**53)
    return share / share.sum(axis=1, keepdims=True)


def mixture_counts(
    entries: np.ndarray, lengths: np.ndarray, marks: np.ndarray, model: Model | None, states: int, size: int
) -> tuple[np.ndarray, np.ndarray]:
    """Expected texts of each state, and classes by states, if each text has one state; without a model from first shares.

    ``entries``: the bags of all texts, one after the other; every text has one entry at least.
    """
    if not len(lengths):
        return np.zeros(states), np.zeros((size, states))
    classes, times = (entries & 0xFFFF).astype(np.intp), (entries >> 16).astype(float)
    if model is None:
        share = first_shares(marks, states)
    else:
        begins = np.cumsum(lengths) - lengths
        logs = np.ascontiguousarray(np.log(model.emit).T)  # state by state: a look-up then stays within a small table
        score = np.stack([np.add.reduceat(of_state[classes] * times, begins) for of_state in logs], axis=1) + np.log(model.start)
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    emit = np.stack([np.bincount(classes, np.repeat(s, lengths) * times, size) for s in share.T], axis=1)
    return share.sum(axis=0), emit


def lasting(model: Model) -> Model:
    """The states of a mixture, made to last through a text."""
    states = len(model.start)
    return Model(model.start, np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), model.emit)


def start_model(texts: list[np.ndarray], class_tokens: np.ndarray, states: int) -> Model:
    """States as a mixture over whole texts, made to last; the same as :func:`train_start` for texts at hand."""
    flat = np.concatenate([np.asarray(t, dtype=np.int64) for t in texts]) if texts else np.zeros(0, np.int64)
    entries, lengths = bags(flat, np.array([len(t) for t in texts], dtype=np.int64))
    marks, model = np.array([mark(t) for t in texts], dtype=np.int64), None
    for _ in range(START_ROUNDS):
        model = estimate(*_mixed(*mixture_counts(entries, lengths, marks, model, states, len(class_tokens))), class_tokens)
    return lasting(model)


def _mixed(start: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of a mixture as those of a model: its states do not move."""
    return start, np.eye(len(start)), emit


def _binary(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The numbers of each text as binary."""
    ends, data = np.cumsum(lengths) * flat.itemsize, flat.tobytes()
    return pa.array([data[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.binary())


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binary`` was given."""
    lengths = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(listed(column)), kind), lengths


def encode(texts: DataFrame, known) -> DataFrame:
    """The classes of each text, written once for all rounds: in order (``classes``) and as a ``bag``, with ``mark`` and ``given`` (not null)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            words, ids, lengths = numbered(batch.column(0))
            flat = known.value.classes(listed(words))[ids]
            marks = [mark(t) for t in np.split(flat, np.cumsum(lengths)[:-1])]
            yield pa.RecordBatch.from_arrays(
                [_binary(flat.astype("<u2"), lengths), _binary(*bags(flat, lengths)), pa.array(marks, pa.int64()), batch.column(0).is_valid()],
                names=["classes", "bag", "mark", "given"],
            )

    return stored(texts.select("text").mapInArrow(each, "classes binary, bag binary, mark long, given boolean"), "classes")


def summed(
    coded: DataFrame, chunk: int, counts: Callable[[pa.RecordBatch], tuple], states: int, size: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First states, moves, and classes by states that ``counts`` gives for batches, over all rows of ``coded``.

    Batches have about ``chunk`` bytes in the first column.  Sums travel as
    rows of SUM_ROWS classes; those of one place meet in one task, as they come.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        for batch in chunks(batches, name, chunk):
            for total, part in zip(totals, counts(batch), strict=True):
                total += part
        start, moves, emit = totals
        table = np.concatenate((start[None], moves, emit))
        yield from rows({a: table[a : a + SUM_ROWS] for a in range(0, len(table), SUM_ROWS) if table[a : a + SUM_ROWS].any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[at] = totals.get(at, 0) + np.frombuffer(values)
        yield from rows(totals)

    def rows(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = [x.tobytes() for x in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(values, pa.binary())], names=["at", "sums"])

    name, kind, table = coded.columns[0], "at long, sums binary", np.zeros((1 + states + size, states))
    for row in coded.mapInArrow(each, kind).repartition("at").mapInArrow(add, kind).collect():
        values = np.frombuffer(row["sums"]).reshape(-1, states)
        table[row["at"] : row["at"] + len(values)] += values
    return table[0], table[1 : 1 + states], table[1 + states :]


def train_start(coded: DataFrame, class_tokens: np.ndarray, states: int) -> Model:
    """Start values from all training texts: states as a mixture over whole texts, made to last.

    A round is one pass over the written bags; what comes to the driver has a row a class.
    """
    context, size = coded.sparkSession.sparkContext, len(class_tokens)
    given, model = coded.where("given").select("bag", "mark"), None
    for _ in range(START_ROUNDS):
        shared = context.broadcast(model)

        def counts(batch: pa.RecordBatch, shared=shared):
            entries, lengths = _numbers(batch.column(0), "<u4")
            return _mixed(*mixture_counts(entries, lengths, batch.column(1).to_numpy(), shared.value, states, size))

        model = estimate(*summed(given, CHUNK, counts, states, size), class_tokens)
        shared.unpersist()
    return lasting(model)


def train_round(coded: DataFrame, class_tokens: np.ndarray, model: Model) -> tuple[Model, float]:
    """One Baum-Welch round over all texts: expected counts by partition, summed, then estimated anew.

    With it comes the log likelihood of all texts before the round.
    """
    shared = coded.sparkSession.sparkContext.broadcast(model)
    states, size = len(model.start), len(class_tokens)

    def counts(batch: pa.RecordBatch):
        start, moves, emit, log = Sequences([np.frombuffer(c, "<u2") for c in listed(batch.column(0))]).expected(shared.value)
        return start, moves, np.concatenate((emit, np.eye(1, states) * log))  # its sum travels as one more class

    start, moves, emit = summed(coded.select("classes"), CODED_CHUNK, counts, states, size + 1)
    shared.unpersist()
    return estimate(start, moves, emit[:size], class_tokens), float(emit[size, 0])


def trained(coded: DataFrame, class_tokens: np.ndarray, model: Model, rounds: int | None) -> Model:
    """The model after so many Baum-Welch rounds; None: after as many as it takes until they have converged.

    They have when the round before raised the log likelihood by CONVERGED of it at most.
    """
    done, before = 0, None
    while rounds is None or done < rounds:
        model, log = train_round(coded, class_tokens, model)
        done += 1
        if rounds is None and before is not None and log - before <= CONVERGED * abs(before):
            break
        before = log
    return model


SCORED = "uid long, doc_id {kind}, word string, times long, n_tokens long, n_known long, base double, model double"


def score(
    documents: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", states: int = STATES, rounds: int | None = ROUNDS
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learns from the rows that are not ``held_out``: counts of all their words,
    start values fitted to all of their texts, and ``rounds`` of Baum-Welch over
    all of them (None: until they have converged).  ``score`` is the log10 probability of the whole text,
    ``base_score`` that of single words with one added to every count.

    Null texts are empty: they have one token, the end.  Repeated rows are
    scored each and count each.  Without training rows the base score is 0.
    Other columns are not used.

    Counts of the HEAD most frequent words are broadcast.  All other words of a
    text meet the table of counts in a join and their sums go back to the text.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out.alias("held_out"))
    training = rows.where(~F.coalesce("held_out", F.lit(False))).select("doc_id", "text")
    words = stored(count_words(training), "words")
    ends = training.count()
    known = spark.sparkContext.broadcast(vocabulary(words, ends))

    coded, class_tokens = encode(training, known), known.value.class_tokens()
    model = trained(coded, class_tokens, train_start(coded, class_tokens, states), rounds)
    shared = spark.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value, known.value
        in_class = -np.log10(words.suffix_tokens + words.suffix_words + 1)
        logs = np.log10(words.counts + 1)
        for batch in chunks(batches, "text", CHUNK):
            uid, (distinct, ids, lengths) = batch.column(0).to_numpy(), numbered(batch.column(2))
            as_bytes = listed(distinct)
            ranks = words.ranks_of(as_bytes)
            classes = words.classes(as_bytes, ranks)
            begins = np.cumsum(lengths) - lengths
            whole = Sequences(np.split(classes[ids], begins[1:])).forward(model)[0] / np.log(10)
            # What each distinct word, and after them the end, adds to its text.
            of_word = np.where(ranks >= 0, logs[ranks], 0.0) if len(logs) else np.zeros(len(ranks))
            known_by = np.append(ranks >= 0, words.ends > 0).astype(np.int64)
            base_by = np.append(of_word, np.log10(words.ends + 1))
            in_state = np.where(classes < SUFFIXES, in_class[np.minimum(classes, SUFFIXES - 1)], 0.0)
            model_by = in_state + np.append(np.where(ranks >= words.own, of_word, 0.0), 0.0)
            # Words outside the head have a row for each text that has them.
            outside = np.append(ranks < 0, False)[ids]
            owner = np.repeat(np.arange(len(lengths)) * len(classes), lengths)
            found, times = np.unique((owner + ids)[outside], return_counts=True)
            row, word = np.divmod(found, len(classes))
            none = np.zeros(len(found), np.int64)
            sums = lambda by: np.concatenate((np.add.reduceat(by[ids], begins), none))
            marks = pa.array([f"\n{u}" for u in uid.tolist()], pa.string())  # no word has a line end: this row meets no count
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((uid, uid[row]))), pa.concat_arrays([batch.column(1), pa.nulls(len(found), batch.column(1).type)]),
                    pa.concat_arrays([marks, distinct.take(pa.array(word))]), pa.array(np.concatenate((np.zeros_like(uid), times))),
                    pa.array(np.concatenate((lengths, none)).astype(np.int64)), pa.array(sums(known_by)),
                    pa.array(sums(base_by).astype(float)), pa.array(np.concatenate((whole + sums(model_by)[: len(uid)], none.astype(float)))),
                ],
                names=["uid", "doc_id", "word", "times", "n_tokens", "n_known", "base", "model"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(each, SCORED.format(kind=kind))
    seen = words.select("word", F.col("n").alias("seen")).hint("merge")
    joined = parts.join(seen, "word", "left").withColumn("log", F.col("times") * F.log10(F.coalesce("seen", F.lit(0)) + 1))
    per_token = float(np.log10(known.value.total + known.value.distinct + 1))
    return (
        joined.groupBy("uid").agg(
            F.max("doc_id").alias("doc_id"),
            F.sum("n_tokens").alias("n_tokens"),
            (F.sum("n_known") + F.sum(F.when(F.col("seen") > 0, F.col("times")).otherwise(0))).alias("n_known"),
            (F.sum("base") + F.sum("log")).alias("base"),
            (F.sum("model") + F.sum("log")).alias("score"),
        )
        .select(
            "doc_id", "n_tokens", "n_known", F.lit(known.value.total).cast("long").alias("train_tokens"),
            (F.col("base") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
        )
    )
