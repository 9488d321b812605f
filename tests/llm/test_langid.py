from functools import lru_cache
import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from starqa.llm import langid
from starqa.llm.queries import QUERIES

PIECES = ["▁", "a", "b", "▁a", "ab", "ba", "▁ab", "aba"]


def sums(word, log_p):
    """The probability of a word by trying every cut; unknown characters are the last piece."""
    text = "▁" + word

    @lru_cache(None)
    def rest(i):
        if i == len(text):
            return 1.0
        total = sum(math.exp(log_p[k]) * rest(i + len(p)) for k, p in enumerate(PIECES) if text.startswith(p, i))
        return total if text[i] in PIECES else total + math.exp(log_p[-1]) * rest(i + 1)

    return rest(0)


def test_forward_sums_all_segmentations():
    log_p = np.log(np.array([0.1, 0.2, 0.1, 0.15, 0.1, 0.05, 0.2, 0.05, 0.05]))
    words = ["a", "ab", "abab", "ababa", "xab", "bbxa", "b" * 300]
    lattice = langid.Lattice([w.encode() for w in words], langid._automaton(PIECES), len(PIECES))
    found = lattice.forward(log_p[lattice.piece][:, None])[lattice.finish][:, 0]
    assert np.allclose(found[:6], [math.log(sums(w, log_p)) for w in words[:6]]) and np.isfinite(found[6])
    assert np.allclose(found, lattice.backward(log_p[lattice.piece][:, None])[lattice.begin][:, 0])


def test_expected_counts_add_up():
    start = np.log(np.full(len(PIECES) + 1, 1 / 9))
    words = [b"abab", b"ba", b"xa"]
    counts = langid._expected(words, np.array([[1.0], [3.0], [2.0]]), start, langid._automaton(PIECES))[0]
    sizes = [len(p) for p in PIECES] + [1]
    assert np.isclose(counts @ sizes, 1 * 5 + 3 * 3 + 2 * 3)


def test_held_out_accuracy(spark):
    found = QUERIES["op6_language_id"](spark, SMALL)
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    wrong = found.where("held_out").join(given, "doc_id").where("lang <> lang_pred and score > 0")
    assert found.where("held_out").count() > 50 and wrong.count() <= 4  # shouted texts
    assert found.where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_odd_rows(spark, edges, nothing):
    found = langid.identify(edges)
    assert found.columns[-2:] == ["lang_pred_", "score_"]
    rows = found.select("doc_id", "text", "lang_pred_", "score_").collect()
    assert len(rows) == edges.count()
    for r in rows:
        assert (r.lang_pred_ == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert langid.identify(nothing).collect() == []
    unnamed = langid.identify(edges.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in unnamed.select("lang_pred_").collect()} == {"und"}


def segmentations(text, pieces):
    """All ways to cut a text, as lists of piece numbers; a character that is no piece is the last number."""
    if not text:
        yield []
        return
    for k, p in enumerate(pieces):
        if text.startswith(p):
            yield from ([k, *rest] for rest in segmentations(text[len(p) :], pieces))
    if text[0] not in pieces:
        yield from ([len(pieces), *rest] for rest in segmentations(text[1:], pieces))


def plain_posteriors(rows):
    """Expected counts and posteriors by listing every segmentation of every word, one text at a time."""
    start = [1.0 / (k + 10) for k in range(len(PIECES))] + [1e-9]
    start = [p / sum(start) for p in start]
    likely = lambda way, p: math.prod(p[k] for k in way)
    langs = sorted({lang for text, lang in rows if text is not None and lang is not None})
    table = {}
    for lang in langs:
        counts = [langid.SMOOTHING] * len(start)
        for text, own in rows:
            for word in (text or "").split() if own == lang else ():
                ways = list(segmentations("▁" + word, PIECES))
                total = sum(likely(w, start) for w in ways)
                for way in ways:
                    for k in way:
                        counts[k] += likely(way, start) / total
        table[lang] = [c / sum(counts) for c in counts]
    out = []
    for text, _ in rows:
        scores = [sum(math.log(sum(likely(w, table[x]) for w in segmentations("▁" + word, PIECES))) for word in (text or "").split()) for x in langs]
        top = max(scores)
        out.append((langs[scores.index(top)], 1 / sum(math.exp(s - top) for s in scores)))
    return out


def test_predictions_equal_a_plain_version(spark):
    """Learned probabilities and posteriors, over random texts of an alphabet with an unknown character."""
    import random

    from starqa.llm.vocabulary import Pieces

    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    rows = []
    for i in range(60):
        lang, letters = rng.choice([("x", "aab"), ("y", "abbb"), ("z", "abxx"), (None, "abx")])
        rows.append((" ".join(word(letters) for _ in range(rng.randint(1, 5))), lang))
    ids = {p: i for i, p in enumerate(PIECES)}
    pieces = Pieces(ids, dict.fromkeys(ids, 0.0), [0] * 256, [], 3, -10.0)
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    found = langid.identify(frame, pieces=pieces).orderBy("doc_id").collect()
    for r, (lang, score) in zip(found, plain_posteriors(rows), strict=True):
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_products_and_logarithms_agree():
    """Also where products leave the range of doubles."""
    rng = np.random.default_rng(4)
    log_p = np.log(rng.dirichlet(np.ones(len(PIECES) + 1), 3).T)
    words = [b"ab", b"xyz", b"x" * 900, b"ab" * 700, "é".encode() * 40, b"a"]
    lattice = langid.Lattice(words, langid._automaton(PIECES), len(PIECES))
    assert np.allclose(lattice.likelihoods(log_p), lattice.forward(log_p[lattice.piece])[lattice.finish])
    weights = np.array([[1.0, 0.0], [2.0, 1.0], [1.0, 1.0], [0.5, 3.0], [1.0, 0.0], [0.0, 1.0]])
    counts = langid._expected(words, weights, log_p[:, 0], langid._automaton(PIECES))
    sizes = np.array([len(p) for p in PIECES] + [1])
    assert np.allclose(counts @ sizes, weights.T @ np.array([len(w.decode()) + 1 for w in words]))
