import random
from collections import Counter

import zstandard

from starqa.llm import repeats


def by_hand(texts, window):
    lists = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def run(spark, rows, window):
    done = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window)
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in done.collect()))


def wanted(rows, window):
    found = by_hand([t for _, t in rows], window)
    return sorted((i is None, i or 0, *f) for (i, _), f in zip(rows, found))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 2)
    passage = [word() for _ in range(12)]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.randint(0, 60))]
        if i % 7 == 0:
            words[len(words) // 2 : len(words) // 2] = passage
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    return rows + [(200, rows[3][1]), (201, " ".join(["same"] * 50)), (None, rows[8][1]), (5, rows[9][1]), (5, rows[9][1]), (202, None), (203, "")]


def test_equals_brute_force(spark):
    for window in (6, 35):
        assert run(spark, corpus(window), window) == wanted(corpus(window), window)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With every bit set all windows are grouped exactly; the result is the same."""
    rows = corpus(1)
    full = repeats.Sketch({0: zstandard.compress(b"\xff" * (repeats.BLOCK_CELLS // 8))}, repeats.BLOCK_CELLS // repeats.ROWS)
    windows = repeats.Windows([t for _, t in rows], 6)
    assert len(full.maybe_repeated(windows)) == len(windows.hashes)
    monkeypatch.setattr(repeats, "window_sketch", lambda *_: full)
    assert run(spark, rows, 6) == wanted(rows, 6)


def test_odd_rows_and_layout(spark, edges, nothing):
    done = repeats.remove_repeats(edges, 4, layout=True)
    assert done.columns[: len(edges.columns)] == edges.columns
    rows = done.collect()
    assert len(rows) == edges.count()
    name = done.columns[-1]
    assert all(r[name] == r.text for r in rows if not r["n_removed"])
    assert repeats.remove_repeats(nothing).collect() == []
    kept = repeats.remove_repeats(spark.createDataFrame([(1, " a b\nc\td e"), (2, "x b\nc\td y")], "doc_id long, text string"), 3, layout=True)
    assert {r.kept_text for r in kept.collect()} == {" a e", "x y"}
