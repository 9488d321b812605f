import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMALL
from starqa.llm import hmm
from starqa.llm.queries import QUERIES


def tiny(seed, classes=5, states=3):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(classes), states).T)


def paths(model, text):
    """Every path with its probability."""
    for path in product(range(len(model.start)), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for a, b, c in zip(path, path[1:], text[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        yield path, p


def test_forward_and_expected_counts_equal_all_paths():
    model, texts = tiny(1), [[0, 1, 2, 4], [3], [1, 1, 0, 2, 4, 3], [4]]
    found = hmm.Sequences(texts).forward(model)[0]
    assert np.allclose(found, [math.log(sum(p for _, p in paths(model, t))) for t in texts])
    start, moves, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for t in texts:
        whole = sum(p for _, p in paths(model, t))
        for path, p in paths(model, t):
            start[path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                moves[a, b] += p / whole
            for c, s in zip(t, path):
                emit[c, s] += p / whole
    for ours, wanted in zip(hmm.Sequences(texts).expected(model), (start, moves, emit)):
        assert np.allclose(ours, wanted)


def test_very_long_texts_stay_finite():
    model = tiny(2)
    value = hmm.Sequences([[0, 1, 2, 3, 4] * 20_000]).forward(model)[0][0]
    assert np.isfinite(value) and value < -1000


def base(rows, held):
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)))
        for i, t in rows
    ]


def equal(got, wanted):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    wanted = sorted(wanted, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in wanted]
    assert np.allclose([g[4] for g in got], [w[4] for w in wanted])


def test_counts_equal_brute_force_and_held_out_texts_are_likelier(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = QUERIES["op7_hmm_score"](spark, SMALL).collect()
    equal(got, base(rows, held))
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_words_beyond_the_head_are_joined(spark, edges, nothing, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 3)
    monkeypatch.setattr(hmm, "OWN_CLASS", 2)
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    held = F.coalesce(F.col("doc_id") == 7, F.lit(False))
    got = hmm.score(edges, held).collect()
    equal(got, base(rows, lambda i: i == 7))
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.score(nothing, held).collect() == []
    untrained = hmm.score(edges, F.lit(True)).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in untrained) and len(untrained) == len(rows)


def test_probabilities_of_all_next_words_add_up_to_one(spark):
    """Over one-word texts: all known words, and one unknown word for each class that has room for it."""
    rows = [(i, " ".join(f"w{(i * j) % 40}" for j in range(1, 9))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    words = hmm.count_words(frame)
    known = hmm.vocabulary(words, frame.count())
    model = hmm.start_model([known.classes(hmm.tokens(t)) for _, t in rows], known.class_tokens(), 4)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    assert known.class_tokens().sum() == known.total


def plain_scores(rows, held, own, states):
    """Whole-text scores by loops over words and states: one round of Baum-Welch over all training texts, from the given start."""
    tokens = lambda t: (t or "").encode().lower().split()
    training = [(i, t) for i, t in rows if not held(i)]
    counts = Counter(w for _, t in training for w in tokens(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    place = {w: hmm.SUFFIXES + 1 + k for k, w in enumerate(ranked[:own])}
    of = lambda w: place.get(w, zlib.crc32(w[-2:]) % hmm.SUFFIXES)
    classes = lambda t: [*(of(w) for w in tokens(t)), hmm.SUFFIXES]
    size = hmm.SUFFIXES + 1 + min(own, len(ranked))
    in_class = Counter(c for _, t in training for c in classes(t))
    words_in = Counter(of(w) for w in counts if w not in place)
    class_tokens = np.array([float(in_class[c]) for c in range(size)])
    ordered = sorted(training, key=lambda r: (str(r[0]), r[1]))
    begun = hmm.start_model([np.array(classes(t)) for _, t in ordered if t is not None], class_tokens, states)
    S = range(states)

    def forward(cs, start, move, emit):
        rows_, logs, a = [], 0.0, None
        for c in cs:
            a = [(start[s] if a is None else sum(a[r] * move[r][s] for r in S)) * emit[c][s] for s in S]
            scale = sum(a)
            a = [x / scale for x in a]
            logs += math.log(scale)
            rows_.append(a)
        return rows_, logs

    start, move, emit = begun.start.tolist(), begun.move.tolist(), begun.emit.tolist()
    first, moves, emits = [0.0] * states, [[0.0] * states for _ in S], [[0.0] * states for _ in range(size)]
    for _, t in training:
        cs = classes(t)
        a, _ = forward(cs, start, move, emit)
        b = [[1.0] * states]
        for c in reversed(cs[1:]):
            later = [sum(move[s][r] * emit[c][r] * b[0][r] for r in S) for s in S]
            b.insert(0, [x / sum(later) for x in later])
        for k, c in enumerate(cs):
            at = [a[k][s] * b[k][s] for s in S]
            for s in S:
                emits[c][s] += at[s] / sum(at)
                first[s] += at[s] / sum(at) if k == 0 else 0.0
            if k + 1 < len(cs):
                pair = [[a[k][s] * move[s][r] * emit[cs[k + 1]][r] * b[k + 1][r] for r in S] for s in S]
                whole = sum(map(sum, pair))
                for s in S:
                    for r in S:
                        moves[s][r] += pair[s][r] / whole
    share = [(x + 1) / sum(class_tokens + 1) for x in class_tokens]
    lean = [sum(min(emits[c][s], 1) for c in range(size)) + 1 for s in S]
    emits = [[emits[c][s] + lean[s] * share[c] for s in S] for c in range(size)]
    total = [sum(emits[c][s] for c in range(size)) for s in S]
    emit = [[e[s] / total[s] for s in S] for e in emits]
    start = [(x + hmm.EVEN) / (sum(first) + hmm.EVEN * states) for x in first]
    move = [[(x + hmm.EVEN) / (sum(m) + hmm.EVEN * states) for x in m] for m in moves]
    out = []
    for i, t in rows:
        value = forward(classes(t), start, move, emit)[1] / math.log(10)
        value += sum(math.log10((counts[w] + 1) / (in_class[of(w)] + words_in[of(w)] + 1)) for w in tokens(t) if w not in place)
        out.append((i, value))
    return out


def test_scores_of_whole_texts_equal_a_plain_version(spark, monkeypatch):
    """Learned model and words beyond the classes of their own, over several partitions."""
    import random

    monkeypatch.setattr(hmm, "OWN_CLASS", 6)
    rng = random.Random(8)
    word = lambda: rng.choice("abc") * rng.randint(1, 3) + rng.choice(["", "x", "yz"])
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(50)] + [(60, None), (61, "never seen words"), (62, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = lambda i: i % 5 == 1
    got = sorted((r.doc_id, r.score) for r in hmm.score(frame, F.col("doc_id") % 5 == 1, states=2).collect())
    wanted = sorted(plain_scores(rows, held, 6, 2))
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert np.allclose([g[1] for g in got], [w[1] for w in wanted], atol=1e-8)


def test_start_values_come_from_all_training_texts(spark):
    """Also from texts of over 100 KB and beyond the first 2,000; however the rows are dealt."""
    rows = [(i, f"a{i % 7} b{i % 3}") for i in range(2500)] + [(5000, "long " * 30_000), (5001, None), (5002, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.sparkContext.broadcast(hmm.vocabulary(hmm.count_words(frame), len(rows)))
    class_tokens = known.value.class_tokens()
    texts = [known.value.classes(hmm.tokens(t)) for _, t in rows if t is not None]
    wanted = hmm.start_model(texts, class_tokens, 3)
    for parts in (1, 5):
        got = hmm.train_start(hmm.encode(frame.repartition(parts), known), class_tokens, 3)
        assert np.allclose(got.start, wanted.start) and np.allclose(got.emit, wanted.emit)
    less = hmm.start_model(texts[:2500], class_tokens, 3)
    assert not np.allclose(less.emit, wanted.emit)


def test_numbered_words_equal_tokens():
    """All at once as text by text: blanks of every kind and at either side, odd characters, null and empty texts."""
    import random

    rng = random.Random(3)
    alphabet = " \t\n\x0b\x0c\r\x1c\x85\xa0\x00AbCÉß½\U0001f600"
    texts = [None, "", " ", "a", "\n a "] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for some in ([], [None], ["", None], texts):
        words, ids, lengths = hmm.numbered(pa.array(some, pa.string()))
        names = [*hmm.listed(words), None]
        assert len(set(names)) == len(names)
        cuts = np.cumsum([0, *lengths])
        assert [[names[i] for i in ids[a:b]] for a, b in zip(cuts, cuts[1:])] == [[*hmm.tokens(t), None] for t in some]


def test_bags_hold_every_class_once_unless_it_fills_an_entry():
    texts = [np.array(t) for t in ([5, 0, 5], [7], [3] * (2 * hmm.MOST + 1) + [40_000], [2] * hmm.MOST)]
    entries, lengths = hmm.bags(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert entries.dtype == np.dtype("<u4") and lengths.tolist() == [2, 1, 4, 1]
    cuts = np.cumsum([0, *lengths])
    for t, a, b in zip(texts, cuts, cuts[1:]):
        found = Counter()
        for entry in entries[a:b].tolist():
            found[entry & 0xFFFF] += entry >> 16
        assert found == Counter(t.tolist())


def test_a_round_of_the_mixture_reads_bags_and_equals_a_round_over_tokens():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 5, n) for n in (40, 1, 300, 7)]
    model = tiny(5)
    entries, lengths = hmm.bags(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert len(entries) <= 5 * len(texts)
    start, emit = hmm.mixture_counts(entries, lengths, np.zeros(4, np.int64), model, 3, 5)
    shares = [model.start * np.prod([model.emit[c] for c in t], axis=0) for t in texts]
    shares = [s / s.sum() for s in shares]
    assert np.allclose(start, sum(shares))
    assert np.allclose(emit, [sum(s * (t == c).sum() for s, t in zip(shares, texts)) for c in range(5)])


def test_sums_travel_in_rows_of_many_classes(spark):
    """Every partition gives a row for SUM_ROWS classes, not one for each; the sums are those of one partition."""
    rows = [(f"w{i} w{i % 9} w{i * 7 % 50}",) for i in range(300)]
    frame = spark.createDataFrame(rows, "text string")
    known = spark.sparkContext.broadcast(hmm.vocabulary(hmm.count_words(frame), len(rows)))
    size = known.value.size

    def counts(batch):
        flat, lengths = hmm._numbers(batch.column(0), "<u2")
        return np.array([1.0, len(lengths)]), np.ones((2, 2)), np.stack([np.bincount(flat, minlength=size), np.zeros(size)], axis=1)

    start, moves, emit = hmm.summed(hmm.encode(frame.repartition(4), known).select("classes"), 1 << 20, counts, 2, size)
    assert start[1] == 300 and start[0] == moves[0, 0] >= 1
    assert (emit[:, 0] == known.value.class_tokens()).all() and not emit[:, 1].any()


def test_rounds_go_on_until_they_have_converged(spark, monkeypatch):
    """As many as a plain loop over all texts takes; the log likelihood of a round is that of the model before it."""
    monkeypatch.setattr(hmm, "CONVERGED", 1e-4)
    rng = np.random.default_rng(6)
    rows = [(" ".join(f"{'ab'[i % 2]}{rng.integers(6) if rng.random() < 0.8 else rng.integers(40)}" for _ in range(rng.integers(1, 30))),) for i in range(200)]
    frame = spark.createDataFrame([*rows, (None,)], "text string").repartition(3)
    known = spark.sparkContext.broadcast(hmm.vocabulary(hmm.count_words(frame), len(rows) + 1))
    class_tokens = known.value.class_tokens()
    coded = hmm.encode(frame, known)
    begun = hmm.train_start(coded, class_tokens, 3)
    texts = hmm.Sequences([known.value.classes(hmm.tokens(t)) for t, in [*rows, (None,)]])
    model, logs = begun, []
    while len(logs) < 2 or logs[-1] - logs[-2] > 1e-4 * abs(logs[-2]):
        logs.append(texts.forward(model)[0].sum())
        model = hmm.estimate(*texts.expected(model)[:3], class_tokens)
    assert len(logs) > 3
    assert np.isclose(hmm.train_round(coded, class_tokens, begun)[1], logs[0])
    got, one = hmm.trained(coded, class_tokens, begun, None), hmm.trained(coded, class_tokens, begun, 1)
    assert np.allclose(got.emit, model.emit) and np.allclose(got.move, model.move) and np.allclose(got.start, model.start)
    assert not np.allclose(one.emit, model.emit)
    assert hmm.trained(coded.limit(0), class_tokens, begun, None).emit.shape == begun.emit.shape


def test_the_query_trains_beyond_one_round(spark):
    got = QUERIES["op7_hmm_score"](spark, SMALL).where("NOT held_out").agg(F.sum("score")).first()[0]
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    once = hmm.score(spark.read.parquet(f"{SMALL}/documents.parquet"), held)
    one = once.where(~held).agg(F.sum("score")).first()[0]
    assert got - one > hmm.CONVERGED * abs(one)
