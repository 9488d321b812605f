"""Scoring a table of free-text answers against the truth of their tasks.

All four answer types are scored in one pass: an answer is parsed once, its
probes (items, or word runs of a prose answer) meet the aliases of its task in
one equi-join, and one aggregation per answer yields the score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starqa import fixed_values as fixed
from starqa.functions.answers import parse_list, parse_numeric, with_value
from starqa.functions.names import normalize, normalize_all
from starqa.operators.ranking import SLICES
from starqa.sources.storage import stored


def numeric_score(submitted: Column, value: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """1.0 within the absolute or the relative tolerance, else 0.0."""
    off = F.abs(submitted - value)
    share = off / F.abs(F.nullif(value, F.lit(0.0)))
    close = (off <= abs_tol) | F.coalesce(share <= rel_tol, F.lit(False))
    return F.when(F.isnan(submitted), 0.0).when(close, 1.0).otherwise(0.0)


def word_runs(text: Column, longest: Column) -> Column:
    """Distinct runs of 1 to ``longest`` consecutive words of a text."""

    def runs(words: Column) -> Column:
        of_length = lambda n: F.transform(
            F.sequence(F.lit(1), F.size(words) - n + 1),
            lambda start: F.array_join(F.slice(words, start, n), " "),
        )
        lengths = F.sequence(F.lit(1), F.least(longest, F.size(words)))
        return F.array_distinct(F.flatten(F.transform(lengths, of_length)))

    return with_value(F.split(text, " "), runs)


def longest_alias(names: DataFrame) -> DataFrame:
    """One row: the number of words in the longest alias."""
    return names.select(F.explode("aliases").alias("alias")).agg(
        F.coalesce(F.max(F.size(F.split("alias", " "))), F.lit(1)).alias("longest")
    )


#: Words of a name that are looked up at once; a longer name is looked up in pieces of so many.
PIECE = 8
#: Words of a text that one row holds while its runs are made.
SEGMENT = 1024


def _segments(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Texts cut into rows of so many words: ``_id, _mark, _first, _words``.

    Each row also has the first words of the next one, so that every run of up
    to PIECE words lies whole in the row in which it starts.  ``_mark`` tells texts
    of one id apart, ``_first`` is the place of the first word.
    """
    cut = lambda words: F.transform(
        F.sequence(F.lit(0), F.size(words) - 1, F.lit(SEGMENT)),
        lambda at: F.struct(at.alias("first"), F.slice(words, at + 1, F.lit(SEGMENT + PIECE - 1)).alias("words")),
    )
    rows = texts.select(
        F.col(text_id).alias("_id"),
        F.xxhash64(text).alias("_mark"),
        F.explode(with_value(F.split(normalize(F.col(text)), " "), cut)).alias("_segment"),
    )
    return rows.select("_id", "_mark", F.col("_segment.first").alias("_first"), F.col("_segment.words").alias("_words"))


def _standing(segments: DataFrame, pieces: DataFrame, sizes: list[int]) -> DataFrame:
    """Places of texts where a piece stands: columns of ``segments`` and ``pieces``, and ``_at``.

    ``pieces`` has ``_piece`` and ``_size``, its number of words, one of ``sizes``.
    A piece is found by its first two words; the others are compared in the row.
    """
    word = F.get("_words", F.col("_at"))
    begins = ([word] if 1 in sizes else []) + ([F.concat(word, F.lit(" "), F.get("_words", F.col("_at") + 1))] if max(sizes) > 1 else [])
    places = segments.select("*", F.explode(F.sequence(F.lit(0), F.size("_words") - 1)).alias("_at"))
    places = places.select("*", (F.explode(F.array(*begins)) if len(begins) > 1 else begins[0]).alias("_begin"))
    found = places.join(pieces.withColumn("_prefix", F.substring_index("_piece", " ", 2)), F.col("_begin") == F.col("_prefix"))
    here = F.array_join(F.slice("_words", F.col("_at") + 1, F.col("_size")), " ")
    return found.filter((F.col("_size") <= 2) | (here == F.col("_piece"))).drop("_words", "_begin", "_prefix")


def mentions(texts: DataFrame, text_id: str, text: str, names: DataFrame) -> DataFrame:
    """Which names a text mentions as whole words: ``text_id, key``.

    At each place of a text its next two words are looked up among the names, and
    the rest of a longer name is compared in the same row: a text is not sent
    anywhere if the names can be broadcast, only what was found is.  A text is
    worked on in rows of SEGMENT words; a name of more than PIECE words is looked
    up in pieces.
    """
    aliases = stored(
        names.select("key", F.explode("aliases").alias("alias")).filter("alias <> ''").distinct()
        .withColumn("_size", F.size(F.split("alias", " "))),
        "aliases",
    )
    found_sizes = aliases.select(F.least("_size", F.lit(PIECE + 1)).alias("n")).distinct().collect()
    short = sorted(r.n for r in found_sizes if r.n <= PIECE) or [1]
    segments = _segments(texts, text_id, text)
    if short == [1]:
        words = segments.select("_id", F.explode(F.array_distinct("_words")).alias("_word"))
        found = words.join(aliases, F.col("_word") == F.col("alias")).select("_id", "key")
    else:
        wanted = aliases.filter(F.col("_size") <= PIECE).withColumnRenamed("alias", "_piece")
        found = _standing(segments, wanted, short).select("_id", "key")
    if any(r.n > PIECE for r in found_sizes):
        found = found.union(_long_mentions(segments, aliases))
    return found.select(F.col("_id").alias(text_id), "key").distinct()


def _long_mentions(segments: DataFrame, aliases: DataFrame) -> DataFrame:
    """Which names of more than PIECE words are mentioned: ``_id, key``.

    A name is cut into pieces of PIECE words, of which the last may overlap the
    one before.  Where all its pieces are found at their distances, there it stands.
    """
    last = F.col("_size") - PIECE
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(PIECE)), F.array(last)))
    whole = aliases.filter(F.col("_size") > PIECE).select("alias", F.split("alias", " ").alias("_parts"), starts.alias("_starts")).distinct()
    pieces = whole.select("alias", "_parts", F.size("_starts").alias("_n"), F.explode("_starts").alias("_off")).select(
        "alias", "_n", "_off", F.lit(PIECE).alias("_size"), F.array_join(F.slice("_parts", F.col("_off") + 1, F.lit(PIECE)), " ").alias("_piece")
    )
    # Equal texts of one id are one text, and a run at the edge of two rows is in both: each place counts once.
    there = _standing(segments, pieces, [PIECE]).select(
        "_id", "_mark", "alias", "_n", "_off", (F.col("_first") + F.col("_at") - F.col("_off")).alias("_start")
    ).distinct()
    stands = there.groupBy("_id", "_mark", "alias", "_start", "_n").count().filter(F.col("count") == F.col("_n"))
    return stands.select("_id", "alias").distinct().join(aliases, "alias").select("_id", "key")


def _first_candidates(truth: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per task and alias, the entities it names, best placed first.

    An alias that many entities share is cut after as many as the answer has
    positions: an answer of ``k`` items can use up at most ``k - 1`` of them
    before its last item, so none beyond the first ``k`` is ever reached.  The
    cut is taken per slice and then over the slices.
    """
    positions = tasks.select(
        "task_id", F.greatest(F.coalesce(F.nullif("k", F.lit(0)), "n_truth"), F.lit(1)).alias("_k")
    )
    aliased = truth.select(
        "task_id", "lo", "order_key", "key", "hi", F.explode("aliases").alias("alias")
    ).withColumn("_slice", F.pmod(F.xxhash64("key"), F.lit(SLICES)))
    place = Window.partitionBy("task_id", "alias", "_slice").orderBy("lo", "order_key")
    near = (
        aliased.join(positions, "task_id")
        .withColumn("_n", F.row_number().over(place))
        .filter(F.col("_n") <= F.col("_k"))
    )
    entity = F.struct("lo", "order_key", "key", "hi")
    return near.groupBy("task_id", "alias").agg(
        F.slice(F.array_sort(F.collect_list(entity)), 1, F.max("_k")).alias("candidates")
    )


def _lookup(tasks: DataFrame, truth: DataFrame, universe: DataFrame) -> DataFrame:
    """``scope, alias`` to the entities of a task, or of a template's universe.

    For a universe only the least and greatest key are kept: enough to tell
    whether all mentions together name one entity.
    """
    of_task = _first_candidates(truth, tasks).select(
        F.col("task_id").alias("scope"),
        "alias",
        "candidates",
        F.lit(None).cast("string").alias("least_key"),
        F.lit(None).cast("string").alias("greatest_key"),
    )
    of_universe = (
        universe.select("template_id", "key", F.explode("aliases").alias("alias"))
        .groupBy(F.col("template_id").alias("scope"), "alias")
        .agg(F.min("key").alias("least_key"), F.max("key").alias("greatest_key"))
    )
    return of_task.unionByName(of_universe, allowMissingColumns=True)


def _probes(longest: Column) -> Column:
    """What an answer asks the lookup, by answer type."""
    probe = lambda scope, pos, norm: F.struct(
        scope.alias("scope"), pos.cast("int").alias("pos"), norm.alias("norm")
    )
    task, template = F.col("task_id"), F.col("template_id")
    ranked = F.transform(
        F.slice("_norms", 1, F.greatest("_k", F.lit(1))), lambda n, i: probe(task, i, n)
    )
    as_set = F.transform(
        F.array_remove(F.array_distinct("_norms"), ""), lambda n: probe(task, F.lit(0), n)
    )
    named = F.transform("_norms", lambda n: probe(task, F.lit(0), n))
    runs = word_runs(F.col("_text"), longest)
    mentioned = F.flatten(
        F.transform(
            runs,
            lambda n: F.array(probe(template, F.lit(-1), n), probe(task, F.lit(-1), n)),
        )
    )
    kind = F.col("answer_type")
    return (
        F.when(kind == fixed.RANKED_LIST, ranked)
        .when(kind == fixed.ENTITY_SET, as_set)
        .when(kind == fixed.CATEGORICAL, F.concat(named, mentioned))
    )


def _ranked_hits() -> Column:
    """Positions filled from the right band, each entity used once.

    An item goes to the first entity it names that is not used up; it scores if
    that entity may stand at its position.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("used"), F.lit(0).alias("hits")
    )

    def step(state, item):
        free = F.filter(item["candidates"], lambda c: ~F.array_contains(state["used"], c["key"]))
        first = F.get(free, F.lit(0))
        hit = item["pos"].between(first["lo"], first["hi"])
        return F.when(
            hit,
            F.struct(
                F.array_append(state["used"], first["key"]).alias("used"),
                (state["hits"] + 1).alias("hits"),
            ),
        ).otherwise(state)

    return F.aggregate(F.array_sort("_placed"), start, step, lambda s: s["hits"])


def score_answers(
    answers: DataFrame, tasks: DataFrame, truth: DataFrame, universe: DataFrame
) -> DataFrame:
    """``answer_id, task_id, answer_type, score`` for each answer, in [0, 1].

    ``answers`` has answer_id, task_id and answer; the rest comes from
    :func:`starqa.plans.tasks.build_tasks`.  An answer without a task scores 0.
    """
    wanted = tasks.select(
        "task_id", "template_id", "answer_type", "k", "value", "abs_tol", "rel_tol", "n_truth"
    )
    kind = F.col("answer_type")
    listed = kind.isin(fixed.RANKED_LIST, fixed.ENTITY_SET, fixed.CATEGORICAL)
    joined = answers.join(wanted, "task_id", "left")
    # A number is scored as it stands and carries its score along; only the others
    # have names to look up.
    submitted = parse_numeric(F.when(kind == fixed.NUMERIC, F.col("answer")))
    number = numeric_score(submitted, F.col("value"), F.col("abs_tol"), F.col("rel_tol"))
    parsed = (
        joined.withColumn("_number", F.when(kind == fixed.NUMERIC, F.coalesce(number, F.lit(0.0))))
        .withColumn("_items", F.when(listed, parse_list(F.when(listed, F.col("answer")))))
        # a name that is blank once cleaned cannot answer a categorical question
        .withColumn(
            "_items",
            F.when(kind == fixed.CATEGORICAL, F.array_remove("_items", "")).otherwise(F.col("_items")),
        )
        .withColumn("_norms", normalize_all(F.col("_items")))
        .withColumn("_text", normalize(F.when(kind == fixed.CATEGORICAL, F.col("answer"))))
        .withColumn("_k", F.coalesce(F.nullif("k", F.lit(0)), F.col("n_truth")))
        .withColumn("_n_items", F.size("_items"))
        .withColumn("_n_named", F.size(F.array_remove(F.array_distinct("_norms"), "")))
        .withColumn("_longest", longest_alias(universe).scalar())
        .withColumn("_probe", F.explode_outer(_probes(F.col("_longest"))))
    )
    kept = ["task_id", "answer_type", "n_truth", "_k", "_n_items", "_n_named", "_number"]
    probed = parsed.select(
        "answer_id", *kept,
        # An answer without names looks under a scope that is nobody's, not all of them under null.
        F.coalesce("_probe.scope", F.concat(F.lit("\n"), F.col("answer_id").cast("string"))).alias("scope"),
        F.col("_probe.pos").alias("pos"),
        F.col("_probe.norm").alias("alias"),
    )
    found = probed.join(_lookup(tasks, truth, universe), ["scope", "alias"], "left")
    as_item = F.col("candidates").isNotNull() & (F.col("pos") >= 0)
    as_mention = F.col("candidates").isNotNull() & (F.col("pos") < 0)
    first_key = F.get("candidates", F.lit(0))["key"]
    # The sets and lists hold no more than the items of one answer.
    per_answer = found.groupBy("answer_id", *kept).agg(
        F.size(F.collect_set(F.when(as_item, first_key))).alias("_matched"),
        F.count_if(as_item).alias("_matched_items"),
        F.collect_list(
            F.when(
                as_item & (F.col("answer_type") == fixed.RANKED_LIST),
                F.struct("pos", "candidates"),
            )
        ).alias("_placed"),
        F.min("least_key").alias("_least"),
        F.max("greatest_key").alias("_greatest"),
        F.count_if(as_mention).alias("_winner_mentions"),
    )
    union = F.col("n_truth") + F.col("_n_named") - F.col("_matched_items")
    set_score = F.when(
        F.col("n_truth") == 0, F.when(F.col("_n_items") == 0, 1.0).otherwise(0.0)
    ).otherwise(F.col("_matched") / union)
    named_right = (F.col("_n_items") <= F.col("n_truth")) & (
        F.col("_matched_items") == F.col("_n_items")
    )
    only_mention = (F.col("_least") == F.col("_greatest")) & (F.col("_winner_mentions") > 0)
    named_score = (
        F.when((F.col("_n_items") == 0) | (F.col("n_truth") == 0), 0.0)
        .when(named_right | F.coalesce(only_mention, F.lit(False)), 1.0)
        .otherwise(0.0)
    )
    ranked_score = F.when(F.col("_k") > 0, _ranked_hits() / F.col("_k")).otherwise(0.0)
    score = (
        F.when(kind == fixed.ENTITY_SET, set_score)
        .when(kind == fixed.CATEGORICAL, named_score)
        .when(kind == fixed.RANKED_LIST, ranked_score)
        .otherwise(F.col("_number"))
    )
    return per_answer.select(
        "answer_id", "task_id", "answer_type", F.coalesce(score, F.lit(0.0)).alias("score")
    )
