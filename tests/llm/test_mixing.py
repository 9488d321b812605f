from collections import defaultdict

from pyspark.sql import functions as F

from starqa.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    """By the rule as it is told: share by weight, stop at twice the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        rate = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if weight[s] * rate >= 2 * sizes[s]}
        if not stop:
            return out | {s: weight[s] * rate for s in open_}
        for s in stop:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= stop
    return out


def check(frame):
    rows = mixing.mixed_sizes(frame).collect()
    given = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in frame.select("doc_id", "source", "text").collect()]
    assert sorted((r.doc_id or -1, r["size"]) for r in rows) == sorted((i or -1, n) for i, _, n in given)
    sizes = defaultdict(int)
    for _, s, n in given:
        sizes[s] += n
    wanted = targets(sizes)
    taken = defaultdict(int)
    by_size = {(n, round(wanted[s], 6)) for s, n in sizes.items()}
    for r in rows:
        assert r.taken <= 2 * r["size"] and (r.source_size, round(r.target, 6)) in by_size
        taken[r.source_size, round(r.target, 6)] += r.taken
    for (size, target), n in taken.items():
        same = sum(1 for s in sizes if (sizes[s], round(wanted[s], 6)) == (size, target))
        assert abs(n - same * target) <= same * (mixing.BLOCK + 0.02 * target)
    return rows


def corpus(spark):
    size = F.when(F.col("id") % 3 == 0, F.col("id") % 900).otherwise(F.col("id") % 70)
    source = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 6))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), size), lambda i: F.concat(F.lit("w"), F.col("id"), F.lit("_"), i)))
    return spark.range(1200).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"), F.lit(0).alias("size"))


def test_targets_caps_and_reruns(spark):
    frame = corpus(spark)
    first = {r.doc_id: r.taken for r in check(frame)}
    again = {r.doc_id: r.taken for r in mixing.mixed_sizes(frame.repartition(7)).collect()}
    assert first == again and sum(first.values()) > 0


def test_odd_rows(spark, edges, nothing):
    assert len(mixing.mixed_sizes(edges).collect()) == edges.count()
    assert mixing.mixed_sizes(nothing).collect() == []
    empty = mixing.mixed_sizes(edges.where("doc_id in (1, 2, 3)")).collect()
    assert [(r["size"], r.target, r.taken) for r in empty] == [(0, 0.0, 0)] * 3


def test_permutation_is_one_to_one(spark):
    for n in (1, 2, 3, 10, 1000, 4097):
        rows = spark.range(n).select(F.col("id").alias("i"), F.lit(n).cast("long").alias("n"))
        seen = [r.i for r in mixing.permuted(rows, "i", "n").collect()]
        assert sorted(seen) == list(range(n))
        if n == 4097:
            assert sum(a + 1 == b for a, b in zip(seen, seen[1:])) < 100


def test_documents_hold_the_words_drawn(spark, edges, nothing):
    frame = corpus(spark)
    sizes = {r.doc_id: r.taken for r in mixing.mixed_sizes(frame).collect()}
    texts = {r.doc_id: r.text for r in frame.collect()}
    mixed = mixing.mixed_documents(frame)
    assert mixed.columns == frame.columns
    got = defaultdict(int)
    for r in mixed.collect():
        words = r.text.split()
        all_words = texts[r.doc_id].split()
        places = [all_words.index(w) for w in words]
        assert places == sorted(set(places)) and words
        got[r.doc_id] += len(words)
    assert got == {i: n for i, n in sizes.items() if n}
    odd = mixing.mixed_documents(edges)
    assert odd.columns == edges.columns
    taken = sum(r.taken for r in mixing.mixed_sizes(edges).collect())
    rows = odd.select("text", "n_chars").collect()
    assert sum(len(r.text.encode().split()) for r in rows) == taken and all(r.n_chars == len(r.text) for r in rows)
    assert mixing.mixed_documents(nothing).collect() == []


def test_thousands_of_equal_rows(spark):
    """Copies are drawn each for itself; none meets the draws of all others."""
    rows = [(1, "a b c d e f", "x")] * 9000 + [(i, f"only{i} of these", "x") for i in range(2, 500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken = defaultdict(int)
    for r in mixing.mixed_sizes(frame).collect():
        taken[r.doc_id] += r.taken
    got = defaultdict(int)
    for r in mixing.mixed_documents(frame).collect():
        got[r.doc_id] += len(r.text.split())
    assert got == {i: n for i, n in taken.items() if n} and got[1] > 50_000
