import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from starqa.llm import phrases
from starqa.sources.storage import shared_folder


def by_hand(rows, least, longest=5, top=2000):
    """Every phrase of every piece counted as a tuple of words; rows are (lang, text)."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= least}
    scored = []
    for (lang, p), a in frequent.items():
        if any(
            g == lang and len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
            for (g, q), f in frequent.items()
        ):
            continue
        cuts = [(1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        scored.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return out


def found(frame, **limits):
    return sorted(map(tuple, phrases.collocations(frame, **limits).collect()))


def texts(seed, count, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "THE", "the", "ß", "\x00", "a-b", "½"]
    glue = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "\xa0", "?!"]
    whole = ["new york city hall", "as far as i know", "x x x x x x x"]
    out = []
    for _ in range(count):
        parts = [rng.choice(whole) if rng.random() < 0.1 else words[min(int(rng.expovariate(0.15)), len(words) - 1)] for _ in range(rng.randint(0, 120))]
        out.append((rng.choice(["en", "en", "de", None]), "".join(p + rng.choice(glue) for p in parts)))
    return out


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 5, 2000), (2, 3, 7), (3, 20, 2000)])
def test_against_the_plain_version(spark, monkeypatch, seed, least, top):
    monkeypatch.setattr(phrases, "CHUNK", 3000)
    monkeypatch.setattr(phrases, "DENSE", 20)
    monkeypatch.setattr(phrases, "BLOCK", 700)
    rows = texts(seed, 120, 40)
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    wanted = by_hand(rows, least, top=top)
    assert wanted and found(frame, least=least, top=top) == wanted


def test_tiles_count_like_a_counter():
    rng = np.random.default_rng(1)
    for dense, high in ((1 << 16, 50), (10, 3000), (1, 5000), (100, 2**31 - 1)):
        phrases.DENSE, before = dense, phrases.DENSE
        a, b = (np.minimum(rng.geometric(0.01, 5000) * (high // 50 + 1), high).astype(np.int64) for _ in range(2))
        left, right, times, number = phrases.tile_counts(a, b)
        phrases.DENSE = before
        assert {(x, y): t for x, y, t in zip(left.tolist(), right.tolist(), times.tolist())} == Counter(zip(a.tolist(), b.tolist()))
        assert (left[number] == a).all() and (right[number] == b).all()
    assert all(len(x) == 0 for x in phrases.tile_counts(*(np.empty(0, np.int64),) * 2))


def test_packed_numbers():
    rng = np.random.default_rng(2)
    for values in ([], [0], [127, 128, 0, 2**62, 16383, 16384], rng.integers(0, 2**40, 999) >> rng.integers(0, 40, 999)):
        assert phrases.unpacked(phrases.packed(np.array(values, np.int64))).tolist() == list(values)


def test_pairs_lie_evenly_on_the_line():
    """Codes rise with places, tell pairs apart, and no stretch is crowded, however frequent a first half is."""
    f = np.array([5000, 300, 200, *[10] * 400])
    before = np.cumsum(f) - f
    a = np.repeat(np.arange(len(f)), np.minimum(f, len(f)))
    b = np.concatenate([np.arange(min(x, len(f))) for x in f])
    codes, place = phrases._line(a, b, f[a], before[a], 9)
    order = np.argsort(codes)
    assert len(np.unique(codes)) == len(codes) and (np.diff(place[order]) >= 0).all()
    undo = pow(phrases.SPREAD, -1, 1 << 9)
    assert (codes >> 9 == a).all() and ((codes & 511) * undo & 511 == b).all()
    in_block = np.bincount((place / f.sum() * 20).astype(int), minlength=20)
    assert in_block.max() <= 1.3 * f.sum() / 20


def test_odd_rows(spark, edges, nothing):
    assert found(nothing) == []
    rows = [(r.lang, r.text) for r in edges.collect()]
    assert found(edges, least=2) == by_hand(rows, 2)
    hot = [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(edges).collect()]
    # 20,000 times one word: a phrase of five of them lies inside none, shorter ones inside rarer ones only.
    assert ("word word", 19_999, 20_000, 20_000) in {h[:4] for h in hot}
    only = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t.,")], "lang string, text string")
    assert found(only, least=1) == []


def test_arithmetic_beyond_64_bits(spark):
    big = 10**16
    row = spark.createDataFrame([(big, [big + 1, big], [big + 3, big], 9 * big)], "a long, pre array<long>, suf array<long>, n long")
    got = row.select(phrases._lowest_score(F.col("n")).alias("s")).first().s
    assert tuple(got) == (1000 * big * 9 * big // ((big + 1) * (big + 3)), 1, big + 1, big + 3)


def test_ties_go_to_the_first_cut(spark):
    row = spark.createDataFrame([(5, [10, 10, 5], [10, 10, 5], 100)], "a long, pre array<long>, suf array<long>, n long")
    assert tuple(row.select(phrases._lowest_score(F.col("n")).alias("s")).first().s) == (5000, 1, 10, 10)


def test_numbers_of_shorter_phrases_do_not_stay(spark):
    """Sequences and packed pairs go when the next length is written; the result reads none of them."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    rows = texts(4, 60, 30)
    frame = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)
    written = {p.name for p in set(folder.iterdir()) - before}
    assert any(n.startswith("pair-counts-5") for n in written)
    assert not [n for n in written if n.startswith(("word-numbers", "pair-numbers"))]
    assert sorted(map(tuple, frame.collect())) == by_hand(rows, 5)


def test_answers_of_blocks_are_small():
    """Own numbers, places, frequencies and sums come back; a symbol takes a few bytes, not a row of whole numbers."""
    rng = np.random.default_rng(6)
    all_f = np.sort(rng.zipf(1.5, 20_000).clip(100, 10**9))
    j = rng.permutation(20_000)[:8000]
    own, f, before = rng.permutation(50_000)[:8000], all_f[j], (np.cumsum(all_f) - all_f)[j]
    data = phrases._answer(own, j, f, before)
    wanted = [x[np.argsort(j)].tolist() for x in (own, j, f, before)]
    assert [x.tolist() for x in phrases._answered(data)] == wanted
    assert len(data) < 8 * len(j)


def test_ranks_follow_blocks(spark):
    """Ranks are dense, and what comes before a block is the sum of all earlier ones."""
    rows = [(7, 0, 5), (7, 1, 9), (2, 0, 4), (9, 0, 1), (2, 1, 6), (2, 2, 8)]
    found = spark.createDataFrame(rows, "block long, j long, f long")
    starts, count, total = phrases.block_starts(found)
    assert starts == {2: (0, 0), 7: (3, 18), 9: (5, 32)} and (count, total) == (6, 33)
    got = {(r.f, r["rank"]) for r in phrases.ranked(found, starts).collect()}
    assert got == {(4, 0), (6, 1), (8, 2), (5, 3), (9, 4), (1, 5)}
    assert phrases.block_starts(found.limit(0)) == ({}, 0, 0)
