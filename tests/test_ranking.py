"""Tie-aware rankings against a plain computation."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from starqa.operators.ranking import first_per_group, for_each_k, numbered, possible_top, preview, top_k_with_ties, winners


def expected(rows, k):
    """(group, key) -> (tie_group, lo, hi), computed value by value."""
    out = {}
    for group in {g for g, _, _ in rows}:
        values = Counter(v for g, _, v in rows if g == group and v is not None)
        start = 0
        for number, value in enumerate(sorted(values, reverse=True), 1):
            if start >= k:
                break
            for g, key, v in rows:
                if g == group and v == value:
                    out[group, key] = (number, start, start + values[value] - 1)
            start += values[value]
    return out


@pytest.mark.parametrize("seed,span", [(1, 4), (2, 12), (3, 1000), (4, 1)])
def test_top_k_with_ties(spark, seed, span):
    rng = random.Random(seed)
    # group 0 holds most rows
    rows = [
        (0 if rng.random() < 0.7 else rng.randrange(1, 5), key, rng.choice([None, *range(span)]))
        for key in range(400)
    ]
    df = spark.createDataFrame(rows, "g int, key int, v int")
    for k in (1, 3, 5):
        top = top_k_with_ties(df, ["g"], "v", "key", k).collect()
        found = {(r.g, r.key): (r.tie_group, r.lo, r.hi) for r in top}
        assert found == expected(rows, k)
        assert len(top) == len(found)


def test_groups_smaller_than_k_have_no_ranking(spark):
    df = spark.createDataFrame([(1, i, i) for i in range(4)] + [(2, 9, 1)], "g int, key int, v int")
    ranked = for_each_k(top_k_with_ties(df, ["g"], "v", "key", 5), [1, 3, 5])
    counts = {(r.g, r.k): r["count"] for r in ranked.groupBy("g", "k").count().collect()}
    assert counts == {(1, 1): 1, (1, 3): 3, (2, 1): 1}


def test_winners_keep_all_that_tie(spark):
    df = spark.createDataFrame([("x", "a", 2), ("x", "b", 2), ("x", "c", 1)], "g string, key string, v int")
    assert {r.key for r in winners(df, ["g"], "v", "key").collect()} == {"a", "b"}


def test_ranking_is_pruned_before_the_shuffle_and_shared(spark):
    df = spark.range(1000).selectExpr("id % 3 as g", "id as key", "id % 50 as v")
    ranked = top_k_with_ties(df, ["g"], "v", "key", 5)
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "WindowGroupLimit" in final and "Partial" in final
    assert "ReusedExchange" in final
    assert "CartesianProduct" not in final


def test_first_per_group(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (1, 2), (2, 5)], "g int, v int")
    rows = first_per_group(df, ["g"], [F.col("v")], 2).collect()
    assert {(r.g, r.v, r.pos) for r in rows} == {(1, 1, 0), (1, 2, 1), (2, 5, 0)}


@pytest.mark.parametrize("rows,n,shown,cut", [(25, 10, 10, True), (4, 10, 4, False), (10, 10, 10, False)])
def test_preview(spark, rows, n, shown, cut):
    found = preview(spark.range(rows), n, [F.col("id")]).collect()
    assert [r.id for r in found] == list(range(shown))
    assert {r.truncated for r in found} == {cut}


@pytest.mark.parametrize("seed,span", [(1, 4), (2, 300), (3, 10**6), (4, 1)])
def test_possible_top_keeps_every_row_that_may_be_first(spark, seed, span):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, 1, None]), key, rng.choice([None, *(rng.randrange(span) for _ in range(9))])) for key in range(3000)]
    df = spark.createDataFrame(rows, "g int, key int, v int")
    for k in (1, 5):
        near = possible_top(df, ["g"], "v", "key", k)
        top = lambda d: sorted(map(str, top_k_with_ties(d, ["g"], "v", "key", k).collect()))
        assert near.columns == df.columns and top(near) == top(df)
        if span == 10**6:
            assert near.count() <= 3 * (k + 5)


def test_numbered_over_ranges(spark):
    """One group holds most rows and lies in several ranges; equal rows get different numbers."""
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    rows = [("a", i // 2) for i in range(2000)] + [("b", 7)] * 5 + [(None, 1), (None, 0)]
    found = numbered(spark.createDataFrame(rows, "g string, v int").repartition(3), ["g"], [F.col("v")]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    of = {g: sorted((r.pos, r.v) for r in found if r.g == g) for g in ("a", "b", None)}
    assert of["a"] == [(i, i // 2) for i in range(2000)]
    assert of["b"] == [(i, 7) for i in range(5)] and of[None] == [(0, 0), (1, 1)]
