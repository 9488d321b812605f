import math
import random

import numpy as np
from pyspark.sql import functions as F

from starqa.llm.mtree import build_tree, search_tree, top_inner_products, _lifted


def by_hand(rows, k=5):
    """Every row is asked and compared by itself, also where ids repeat."""
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (q, v) in enumerate(kept):
        if q % 50 == 0:
            others = [(i, w) for n, (i, w) in enumerate(kept) if n != at and len(w) == len(v)]
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in others)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_equals_brute_force_with_odd_rows(spark):
    rng = random.Random(5)
    centers = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in centers[i % 5]]) for i in range(900)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # equal vectors, ties
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2050, [math.nan] * 8), (2100, [math.inf] * 8)]
    rows += [(None, [9.0] * 8), (50, [9.0] * 8), (7, [0.0] * 8), (7, [0.0] * 8), (3000, []), (3001, [1.0, 2.0]), (3050, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    got = sorted(tuple(r) for r in top_inner_products(frame, F.col("vec_id") % 50 == 0, page=100).collect())
    assert got == by_hand(rows)
    assert top_inner_products(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_far_nodes_are_not_read():
    rng = np.random.default_rng(0)
    centers = rng.integers(-1000, 1000, (40, 6))
    x = np.repeat(centers, 50, axis=0) + rng.integers(-3, 3, (2000, 6))
    top = float((x * x).sum(axis=1).max())
    tree = build_tree(_lifted(x, top))
    ids, queries = np.arange(2000), x[::100]
    touched = []

    class Seen(np.ndarray):
        def __getitem__(self, rows):
            touched.append(np.size(rows))
            return np.asarray(self)[rows]

    query, row, score = search_tree(tree, x.view(Seen), ids, queries, ids[::100], 5, np.full(20, np.inf), top)
    for q in range(20):
        s = x @ queries[q]
        s[q * 100] = -(1 << 40)
        assert sorted(score[query == q])[::-1] == sorted(s)[::-1][:5]
    assert len(tree.first) > 10 and sum(touched) < 2000 * 20


def test_repeated_ids_and_large_components(spark):
    """Rows of one id beside one another, and components whose products need more than 53 or 63 bits."""
    rows = [(i, [float(i % 7), 1.0 - i % 3]) for i in range(60)]
    rows += [(3, [50.0, 50.0]), (21, [1e7, 1.0]), (21, [1e7, 1.0]), (50, [3.0, -1e8]), (100, [2.0**40, 2.0**21]), (101, [-1.5, 2.0**30])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in top_inner_products(frame, F.col("vec_id") % 50 == 0, page=20).collect())
    top = 2**63 - 1024
    wanted = [(q, n, i, max(-top, min(top, s))) for q, n, i, s in by_hand(rows)]
    assert got == wanted
    first = {r[2] for r in got if r[0] == 0 and r[1] <= 2}
    assert first <= {100, 101, 21, 3}


def test_one_id_with_a_third_of_all_rows(spark):
    rng = random.Random(2)
    rows = [(50, [rng.gauss(0, 1) for _ in range(4)]) for _ in range(150)] + [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300, 600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_inner_products(frame, F.col("vec_id") % 50 == 0, page=64).collect())
    assert got == by_hand(rows)


def test_blocks_of_all_pages_are_not_broadcast(spark):
    """Each block of queries has a row for every page, which Spark does not foresee."""
    frame = spark.range(200).selectExpr("id AS vec_id", "array(sin(id), cos(id)) AS embedding")
    plan = top_inner_products(frame, F.col("vec_id") % 50 == 0, page=20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
