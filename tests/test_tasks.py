"""The task table, draws from it and its closure under grading."""

import random
from collections import Counter
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from starqa.operators.draw import alias_table, numbered_draws, weighted_draw
from starqa.operators.grading import score_answers
from starqa.plans import quality
from starqa.plans.tasks import TICKS, TaskSet, build_tasks, chosen_templates, describe, describe_text, flat_entities, param_grid


@pytest.fixture(scope="module")
def by_template(music_tasks):
    out = {}
    for row in music_tasks.tasks.collect():
        out.setdefault(row.template_id, {})[row.params_json] = row
    return out


def test_viable_tasks(by_template):
    counts = {name: len(rows) for name, rows in by_template.items()}
    assert counts == {
        "customer_count_in_country": 2,
        "total_revenue_in_year": 2,
        "tracks_sold_in_genre_year": 4,
        "top_customers_by_revenue": 1,
        "top_genre_in_country": 2,
        "top_customer_revenue_increase": 2,
        "artists_with_no_sales_in_year": 3,
    }


def test_texts(by_template):
    row = by_template["top_customers_by_revenue"]['{"year":2021,"k":3}']
    assert row.question.startswith("Which 3 customers generated the most revenue in 2021? List them")
    assert row.answer_format.startswith("a numbered list of exactly 3 customer full names")
    assert (row.notes, row.k, row.n_truth) == ("top 3 customers by revenue in 2021", 3, 4)
    row = by_template["total_revenue_in_year"]['{"year":2021}']
    assert (row.value, row.notes, row.abs_tol, row.rel_tol) == (7.94, "total revenue 2021 = 7.94", 0.01, 1e-3)
    row = by_template["customer_count_in_country"]['{"country":"Brazil"}']
    assert (row.value, row.notes, row.abs_tol, row.rel_tol) == (2.0, "2 customers in Brazil", 0.0, 0.0)
    row = by_template["top_genre_in_country"]['{"country":"Brazil"}']
    assert (row.k, row.notes) == (1, "top genre in Brazil: Latin")
    row = by_template["artists_with_no_sales_in_year"]['{"genre":"Rock","year":2021}']
    assert row.notes == "1 Rock artists with no sales in 2021"
    assert row.task_id == md5(b'artists_with_no_sales_in_year{"genre":"Rock","year":2021}').hexdigest()


def test_weights(music, by_template):
    grid = param_grid(music).groupBy("template_id").agg(F.sum("ticks"), F.count("*")).collect()
    assert len(grid) == 9 and all(0 <= TICKS - r[1] < r[2] for r in grid)
    assert by_template["top_customer_revenue_increase"]['{"year_a":2021,"year_b":2023,"k":3}'].ticks == TICKS // 2
    assert by_template["tracks_sold_in_genre_year"]['{"genre":"Rock","year":2021}'].ticks == TICKS // 6


def test_describe(music_tasks, by_template):
    texts = {}
    for r in sorted(describe(music_tasks).collect(), key=lambda r: (r.lo, r.order_key)):
        texts[r.task_id] = f"{texts[r.task_id]}; {r.text}" if r.task_id in texts else r.text
    text = lambda name, params: texts[by_template[name][params].task_id]
    assert text("total_revenue_in_year", '{"year":2021}') == "7.94"
    assert text("customer_count_in_country", '{"country":"Brazil"}') == "2.0"
    assert text("top_customers_by_revenue", '{"year":2021,"k":3}') == (
        "1-2. Ana Silva (tied); 1-2. Bo Silva (tied); 3-4. Cy Lund (tied); 3-4. Di (tied)"
    )
    assert text("artists_with_no_sales_in_year", '{"genre":"Latin","year":2023}') == "{AC/DC}"
    assert text("top_genre_in_country", '{"country":"Norway"}') == "1. Rock"


@pytest.mark.parametrize("names", [1, 3, 1000])
def test_describe_text(music_tasks, by_template, names):
    rows = sorted(describe_text(music_tasks, names).collect(), key=lambda r: (r.task_id, r.chunk))
    texts = {}
    for r in rows:
        texts[r.task_id] = texts.get(r.task_id, "") + r.text
    text = lambda name, params: texts[by_template[name][params].task_id]
    assert text("total_revenue_in_year", '{"year":2021}') == "7.94"
    assert text("top_customers_by_revenue", '{"year":2021,"k":3}') == "1-2. Ana Silva | Bo Silva (tied); 3-4. Cy Lund | Di (tied)"
    assert text("artists_with_no_sales_in_year", '{"genre":"Latin","year":2023}') == "{AC/DC}"
    assert text("top_genre_in_country", '{"country":"Norway"}') == "1. Rock"
    assert len(texts) == music_tasks.tasks.count()


def test_aliases(music_tasks):
    rows = flat_entities(music_tasks.truth).filter("key = '1'").select("alias").distinct().collect()
    assert {r.alias for r in rows} == {"ana silva", "1", "silva"}


def test_describe_lists_a_large_tie_name_by_name(spark):
    truth = spark.range(2500).select(
        F.lit("t").alias("task_id"), F.lit("winner").alias("role"), F.lit(0).cast("bigint").alias("lo"),
        F.lit(2499).cast("bigint").alias("hi"), F.lpad(F.col("id").cast("string"), 20, "0").alias("order_key"),
        F.concat(F.lit("n"), "id").alias("display"),
    )
    tasks = spark.createDataFrame([], "task_id string, answer_type string, value double")
    lines = describe(TaskSet(tasks, truth, None)).orderBy("lo", "order_key").collect()
    assert [r.text for r in lines] == [f"1-2500. n{i} (tied)" for i in range(2500)]


def test_prompt_and_repeated_templates(music, by_template):
    once = by_template["total_revenue_in_year"]['{"year":2021}']
    assert once.prompt == f"{once.question}\n\nAnswer format: {once.answer_format}"
    twice = build_tasks(music, ["total_revenue_in_year", "total_revenue_in_year"]).tasks
    row = {r.params_json: r for r in twice.collect()}['{"year":2021}']
    assert twice.count() == len(by_template["total_revenue_in_year"]) and row.ticks == 2 * once.ticks


def test_template_filters(music):
    assert chosen_templates(["top_artists_by_revenue"]) == ["top_artists_by_revenue"]
    assert len(chosen_templates(difficulties=["single_table"])) == 3
    with pytest.raises(KeyError):
        chosen_templates(["no_such_template"])
    with pytest.raises(ValueError):
        chosen_templates(["top_artists_by_revenue"], ["single_table"])
    only = build_tasks(music, ["customer_count_in_country"])
    assert only.tasks.count() == 2 and only.truth.count() == 0


def test_truth_scores_one(music_tasks):
    """Any ordering of tied names is a right answer."""
    texts = music_tasks.truth.join(music_tasks.tasks.select("task_id", "k"), "task_id")
    for order in (F.col("order_key"), F.reverse("order_key")):
        placed = F.array_sort(F.collect_list(F.struct("lo", order.alias("o"), "display")))
        names = texts.groupBy("task_id").agg(placed.alias("p")).select(
            "task_id", F.transform("p", lambda p: p["display"]).alias("names")
        )
        listed = names.select("task_id", F.array_join("names", "\n").alias("answer"))
        numeric = music_tasks.tasks.filter("answer_type = 'numeric'").select(
            "task_id", F.col("value").cast("string").alias("answer")
        )
        answers = listed.union(numeric).withColumn("answer_id", F.col("task_id"))
        graded = score_answers(answers, music_tasks.tasks, music_tasks.truth, music_tasks.universe)
        assert {r.score for r in graded.collect()} == {1.0}
        assert graded.count() == music_tasks.tasks.count()


def test_no_incomplete_tasks(music_tasks):
    assert quality.incomplete_tasks(music_tasks).count() == 0


def draw(spark, items, n, seed):
    return {
        r.draw_id: r.item
        for r in weighted_draw(numbered_draws(spark, n), "draw_id", items, "item", "ticks", seed).collect()
    }


def plain_alias_table(weights):
    """Light items one after another take from the heavy item in turn; what a heavy one gives too much the next one gives it."""
    order = sorted((n for n in weights if weights[n] > 0), key=lambda n: (md5(n.encode()).hexdigest()[:2], n))
    full, scaled = sum(weights.values()), {n: weights[n] * len(order) for n in order}
    light = iter([n for n in order if scaled[n] < full])
    heavy = [n for n in order if scaled[n] >= full]
    table, left = {}, {n: scaled[n] for n in heavy}
    for place, giver in enumerate(heavy):
        while left[giver] > full and (taker := next(light, None)) is not None:
            table[taker] = (scaled[taker], giver)
            left[giver] -= full - scaled[taker]
        after = heavy[place + 1] if place + 1 < len(heavy) else giver
        table[giver] = (min(left[giver], full), after)
        if left[giver] < full:
            left[after] -= full - left[giver]
    return [(n, *table[n]) for n in order], full


WEIGHTS = [
    [1, 5, 0, 1000, 3, 7, 250, 1],
    [4] * 9,
    [1],
    [1] * 40 + [1000],
    [0, 2, 2, 3, 1, 2],
    [10, 10, 10, 1, 1, 1, 1, 30, 16, 10],
]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_alias_table(spark, weights):
    """The table of a plain construction, and every item has its exact share of all slots."""
    named = {f"item{i}": w for i, w in enumerate(weights)}
    rows = alias_table(spark.createDataFrame(list(named.items()), "item string, ticks bigint"), "item", "ticks").collect()
    table, full = plain_alias_table(named)
    assert {r.slot: (r.own.item, r.threshold) for r in rows} == {i: (n, t) for i, (n, t, _) in enumerate(table)}
    assert {r.slot: r.other.item for r in rows if r.threshold < full} == {i: o for i, (_, t, o) in enumerate(table) if t < full}
    share = Counter()
    for r in rows:
        share[r.own.item] += r.threshold
        share[r.other.item] += r.full - r.threshold
    assert {n: s for n, s in share.items() if s} == {n: w * len(table) for n, w in named.items() if w}


def test_alias_table_over_many_items(spark):
    """Random weights of very different sizes over many partitions, in the plain construction's order."""
    rng = random.Random(8)
    named = {f"n{i}": int(rng.paretovariate(0.6)) for i in range(3000)}
    items = spark.createDataFrame(list(named.items()), "item string, ticks bigint").repartition(5)
    rows = {r.slot: r for r in alias_table(items, "item", "ticks").collect()}
    table, full = plain_alias_table(named)
    assert [(rows[i].own.item, rows[i].threshold) for i in range(3000)] == [(n, t) for n, t, _ in table]
    assert all(rows[i].other.item == o for i, (_, t, o) in enumerate(table) if t < full)


def test_draw_equals_a_plain_look_at_the_table(spark):
    named = {f"item{i}": w for i, w in enumerate(WEIGHTS[0])}
    found = draw(spark, spark.createDataFrame(list(named.items()), "item string, ticks bigint"), 500, 3)
    table, full = plain_alias_table(named)

    def plain(i):
        digits = md5(f"3|{i}".encode()).hexdigest()
        slot, rest = (int(digits[a : a + 15], 16) * size // 16**15 for a, size in ((0, len(table)), (15, full)))
        own, threshold, other = table[slot]
        return own if rest < threshold else other

    assert found == {i: plain(i) for i in range(500)}


def test_draw_is_seeded_and_weighted(spark, music_tasks):
    items = music_tasks.tasks.select(F.col("task_id").alias("item"), "ticks")
    first, again, other = (draw(spark, items, 2000, seed) for seed in (5, 5, 6))
    assert first == again and first != other and len(first) == 2000
    ticks = {r.item: r.ticks for r in items.collect()}
    total = sum(ticks.values())
    counts = Counter(first.values())
    for item, weight in ticks.items():
        share = weight / total
        assert abs(counts[item] / 2000 - share) < 5 * (share * (1 - share) / 2000) ** 0.5


def test_draw_from_nothing_fails(spark):
    items = spark.createDataFrame([], "item string, ticks bigint")
    with pytest.raises(Exception, match="none is viable"):
        draw(spark, items, 3, 1)


def test_one_item_with_nearly_all_the_weight(spark):
    """Every item has one slot, and every draw exactly one item."""
    items = spark.range(100_000).select(
        F.col("id").cast("string").alias("item"), F.when(F.col("id") == 7, 10**9).otherwise(1).cast("bigint").alias("ticks")
    )
    rows = weighted_draw(numbered_draws(spark, 2000), "draw_id", items, "item", "ticks", 3).collect()
    assert len(rows) == 2000 and sum(r["item"] == "7" for r in rows) > 1990
