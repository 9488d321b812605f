import random
from collections import Counter

import math

import numpy as np

from starqa.llm import quality


def counts(text):
    """The base rules as they are told."""
    words = text.encode().split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x.encode().split() and x in lines[:i])
    return (
        sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(repeated),
    )


def test_base_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", "é ", "\n", "\n", "x|", "# ", "\t", " ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert quality.base_counts(text, text.encode().split()) == counts(text)


def test_classes_and_distance():
    assert quality.char_classes("aB1 \n.#中\U00020000").tolist() == [1, 1, 2, 1, 1, 1, 1, 1]
    p = np.array([1.0, 0.0])
    assert quality.distance(p, p) == 0 and quality.distance(p, p[::-1]) == 1


def prose(rng, lang, n):
    common = {"x": ["the", "of", "and", "to"], "y": ["der", "die", "und", "zu"]}[lang]
    word = lambda: "".join(rng.choice("aeiourstn") for _ in range(rng.randint(3, 9)))
    return " ".join(rng.choice(common) if rng.random() < 0.5 else word() for _ in range(n))


def test_junk_is_turned_away_and_prose_stays(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "xy"[i % 2], rng.randint(60, 200)), "xy"[i % 2]) for i in range(200)]
    junk = [
        (1000, prose(rng, "x", 100).upper().replace(" ", "!! "), "x"),
        (1001, " ".join(f"{i}|{i * 7}" for i in range(100)), None),
        (1002, " ".join("".join(rng.choice("qxz") for _ in range(6)) for _ in range(100)), None),
    ]
    short = [(2000, "SHOUT " * 10, "x"), (2001, "the of and " * 60, "x")]
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame(rows + junk + short, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i, _, _ in rows)
    assert not any(got[i].kept or got[i].base_failed for i, _, _ in junk)
    assert got[2000].base_failed and got[2001].base_failed and got[2000].char_distance is None


def plain_distance(p, q):
    """Jensen-Shannon distance by its definition."""
    share = lambda x: [v / sum(x) for v in x]
    p, q = share(p), share(q)
    half = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, half) if a > 0)
    return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))


def plain_rate(rows):
    """kept and both distances of (text, lang) rows, with references counted over all of them one by one."""
    classes, words = {}, {}
    for text, lang in rows:
        if text is not None and lang is not None:
            classes.setdefault(lang, np.zeros(8)).__iadd__(quality.char_classes(text))
            words.setdefault(lang, Counter()).update(text.encode().split())
    common = {x: dict(sorted(c.items(), key=lambda i: (-i[1], i[0]))[:64]) for x, c in words.items()}
    every = sorted(set().union(*common.values()))
    share = {x: [common[x].get(w, 0) / sum(words[x].values()) for w in every] for x in words}
    share = {x: [*s, 1 - sum(s)] for x, s in share.items()}
    out = []
    for text, _ in rows:
        own = (text or "").encode().split()
        by_char = by_word = None
        if len(text or "") >= 200:
            by_char = min(plain_distance(quality.char_classes(text), c) for c in classes.values())
        if len(own) >= 50:
            counts = Counter(w if w in every else None for w in own)
            by_word = min(plain_distance([counts[w] for w in every] + [counts[None]], s) for s in share.values())
        bound = min(0.48, 0.26 + 1.8 / math.sqrt(max(len(own), 1)))
        failed = len(own) < 50 or 100 * counts_of(text)[3] > 50 * len(own)
        out.append((not failed and (by_char or 0) <= 0.30 and (by_word or 0) <= bound, by_char, by_word))
    return out


def counts_of(text):
    return counts(text or "")


def test_verdicts_equal_a_plain_version(spark):
    rng = random.Random(12)
    odd = lambda n: " ".join("".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(n))
    rows = [(prose(rng, "xy"[i % 2], rng.randint(1, 300)), "xy"[i % 2]) for i in range(80)]
    rows += [(odd(n), None) for n in (60, 100, 400, 3000)] + [(prose(rng, "x", 120).upper(), None), (None, "x"), ("", "y"), ("1 " * 300, None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    for r, (kept, by_char, by_word) in zip(quality.rate(frame).orderBy("doc_id").collect(), plain_rate(rows), strict=True):
        assert r.kept == kept, r
        for found, wanted in ((r.char_distance, by_char), (r.word_distance, by_word)):
            assert (found is None) == (wanted is None) and (found is None or abs(found - wanted) < 1e-9)


def test_long_texts_without_common_words_are_turned_away(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "xy"[i % 2], rng.randint(60, 200)), "xy"[i % 2]) for i in range(200)]
    made_up = " ".join("".join(rng.choice("aeiourstn") for _ in range(rng.randint(3, 9))) for _ in range(3000))
    got = {r.doc_id: r for r in quality.rate(spark.createDataFrame([*rows, (1000, made_up, None)], "doc_id long, text string, lang string")).collect()}
    assert not got[1000].kept and not got[1000].base_failed and got[1000].word_distance < quality.MAX_WORD_DISTANCE + 0.3
    assert all(got[i].kept for i, _, _ in rows)


def test_odd_rows(spark, edges, nothing):
    rows = quality.rate(edges).collect()
    assert len(rows) == edges.count()
    for r, text in ((r, t.text) for r in rows for t in edges.collect() if t.doc_id == r.doc_id == 6):
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text)[:3] + (20_000,)
    assert quality.rate(nothing).collect() == []
    assert [r.kept for r in quality.rate(spark.createDataFrame([(1, " ".join(map(str, range(99))), None)], "doc_id long, text string, lang string")).collect()] == [True]
