import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from starqa.llm import simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fingerprints):
    """Index of the first member of each one's class, by comparing all pairs."""
    owner = list(range(len(fingerprints)))

    def root(i):
        while owner[i] != i:
            i = owner[i]
        return i

    for i in range(len(fingerprints)):
        for j in range(i):
            if (fingerprints[i] ^ fingerprints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                owner[b] = a
    return [root(i) for i in range(len(fingerprints))]


def test_anchors_cover():
    rng = np.random.default_rng(3)
    fp = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    _, owner, anchor = simhash.anchors(fp)
    pairs = set(zip(owner.tolist(), anchor.tolist()))
    assert len(pairs) == len(owner)
    for i, x in enumerate(fp.view(np.uint64).tolist()):
        near = [x] + [x ^ 1 << a ^ (1 << b if b != a else 0) for a in range(64) for b in range(a + 1)]
        homes = simhash.anchors(np.array(near, dtype=np.uint64).view(np.int64))[0]
        assert all((i, h) in pairs for h in homes.tolist())


def test_classes_equal_brute_force(spark, edges):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefghijk") * 2 + rng.choice("xyz") for _ in range(150)) for _ in range(20)]
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "New"
        rows.append((100 + i, " ".join(words)))
    got = {}
    for r in simhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault((r.doc_id, r.fp), set()).add(r.component_id)
    prints = [fingerprint(t) for _, t in rows]
    of = classes(prints)
    for (i, _), fp, c in zip(rows, prints, of):
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == c and rows[j][0] is not None]
        signed = fp - (1 << 64) if fp >> 63 else fp
        assert got[i, signed] == {min(ids, default=None)}
    assert len(set(of)) > 15


def test_replicas_of_few_fingerprints_are_not_broadcast(spark):
    """About 71 rows a fingerprint, which Spark does not foresee."""
    few = spark.range(100).select(F.xxhash64("id").alias("fp"))
    plan = simhash.links(few)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_chains_and_hot_stars_become_one(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1001 + i) for i in range(300)]
    found = simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.root for r in found if r.node < 1000} == {0} and {r.root for r in found if r.node >= 1000} == {1000}
    assert len(found) == 61 + 301
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_class_keeps_columns(spark, edges, nothing):
    kept = simhash.one_of_each_class(edges)
    assert kept.columns == edges.columns
    # Texts without words are one class, the three equal sentences another.
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 6, 7]
    assert simhash.one_of_each_class(nothing).collect() == []
    assert simhash.near_duplicate_classes(nothing.withColumn("x", F.lit(1))).collect() == []
