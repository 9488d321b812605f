"""The task table: every viable question with its truth.

``tasks``   one row per viable question: task_id, template_id, difficulty,
            params_json, question, answer_format, prompt, answer_type, k, value,
            abs_tol, rel_tol, notes, n_truth, ticks
``truth``   one row per correct entity: task_id, role, lo, hi, key, display,
            order_key, aliases
``universe``  candidates a categorical answer may mention, once per template
            rather than once per task: template_id, key, display, aliases

``ticks`` is the weight of the task as a whole number: the probability that a
uniform choice of template and parameters arrives at it, times ``TICKS``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starqa import fixed_values as fixed
from starqa.functions.money import cents_text
from starqa.functions.names import alias_set
from starqa.operators.ranking import numbered
from starqa.operators.sales import dated_revenue, with_stored_aggregates
from starqa.plans import questions
from starqa.sources.storage import stored
from starqa.sources.warehouse import Star

TICKS = 10**12

PARAMS = {"country": "string", "genre": "string", "year": "int", "year_a": "int", "year_b": "int", "k": "int"}


class Choices:
    """The values each parameter can take; looked up once, when first needed."""

    def __init__(self, star: Star):
        self._star = star

    @cached_property
    def years(self) -> list[int]:
        """Years with sales, ascending: one row, bounded by the calendar."""
        return list(questions.year_row(dated_revenue(self._star)).first()["years"])

    @cached_property
    def _countries(self) -> tuple[int, int]:
        enough = F.count_if(F.col("customers") >= fixed.MIN_CUSTOMERS_PER_COUNTRY)
        every, eligible = questions.customers_per_country(self._star).agg(F.count("*"), enough).first()
        return every, eligible or every

    @property
    def countries(self) -> int:
        return self._countries[0]

    @property
    def eligible(self) -> int:
        """Countries the top-genre question may be asked of."""
        return self._countries[1]

    @cached_property
    def genres(self) -> int:
        return questions.genre_universe(self._star).count()


def _later_years(choices: Choices) -> str:
    """SQL for the number of years after the first of a pair."""
    years = ", ".join(map(str, choices.years))
    return f"size(filter(array({years}), y -> y > params.year_a))"


KS = len(fixed.TOP_KS)


@dataclass(frozen=True)
class Template:
    """One question: how its answers are found and among how many it is chosen."""

    answers: Callable[[Star, Choices], DataFrame]
    among: Callable[[Choices], int | str]
    needs: tuple[str, ...] = ()


REGISTRY = {
    "customer_count_in_country": Template(
        lambda star, c: questions.customer_count_in_country(star), lambda c: c.countries
    ),
    "total_revenue_in_year": Template(
        lambda star, c: questions.total_revenue_in_year(star),
        lambda c: len(c.years),
        ("customer_year",),
    ),
    "tracks_sold_in_genre_year": Template(
        lambda star, c: questions.tracks_sold_in_genre_year(star),
        lambda c: c.genres * len(c.years),
        ("track_year", "customer_year"),
    ),
    "top_customers_by_revenue": Template(
        lambda star, c: questions.top_customers(star),
        lambda c: len(c.years) * KS,
        ("customer_year",),
    ),
    "top_artists_by_revenue": Template(
        lambda star, c: questions.top_artists(star),
        lambda c: len(c.years) * KS,
        ("artist_year", "customer_year"),
    ),
    "top_genre_in_country": Template(
        lambda star, c: questions.top_genre_in_country(star),
        lambda c: c.eligible,
        ("country_genre",),
    ),
    "top_countries_by_revenue": Template(
        lambda star, c: questions.top_countries(star),
        lambda c: len(c.years) * KS,
        ("customer_year",),
    ),
    "top_customer_revenue_increase": Template(
        lambda star, c: questions.revenue_increase(star, years=c.years),
        # an earlier year first, then one of the years after it
        lambda c: f"{(len(c.years) - 1) * KS} * {_later_years(c)}",
        ("customer_year",),
    ),
    "artists_with_no_sales_in_year": Template(
        lambda star, c: questions.no_sales_in_year(star, years=c.years),
        lambda c: c.genres * len(c.years),
        ("track_year", "customer_year"),
    ),
}


def chosen_templates(
    template_ids: Sequence[str] | None = None, difficulties: Sequence[str] | None = None
) -> list[str]:
    """Templates by id and tier; unknown ids and an empty choice are errors.

    An id that is named more than once is in the list as often: its tasks are
    made once and weigh so many times as much.
    """
    unknown = sorted(set(template_ids or ()) - set(REGISTRY))
    if unknown:
        raise KeyError(f"Unknown template id(s): {unknown}")
    tiers = {str(d) for d in difficulties or fixed.DIFFICULTIES}
    chosen = [
        name
        for name in (template_ids or REGISTRY)
        if fixed.TEMPLATES[name]["difficulty"] in tiers
    ]
    if not chosen:
        raise ValueError("No task templates match the requested filters.")
    return chosen


@dataclass(frozen=True)
class TaskSet:
    tasks: DataFrame
    truth: DataFrame
    universe: DataFrame


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _params(columns: list[str]) -> str:
    """SQL for the struct of all parameters, null where a template has none."""
    fields = ", ".join(
        f"{_literal(name)}, cast({name if name in columns else 'null'} as {kind})"
        for name, kind in PARAMS.items()
    )
    return f"named_struct({fields})"


def _kind(template_id: str) -> str:
    return fixed.TEMPLATES[template_id]["answer_type"]


def _identified(df: DataFrame, template_id: str, *columns: Column | str) -> DataFrame:
    params = _params(df.columns)
    return df.select(
        F.lit(template_id).alias("template_id"),
        F.expr(f"md5(concat({_literal(template_id)}, to_json({params})))").alias("task_id"),
        F.expr(params).alias("params"),
        *columns,
    )


def _entities(answers: DataFrame, template_id: str) -> DataFrame:
    """Correct entities of one template, under the common columns."""
    if _kind(template_id) == fixed.ENTITY_SET:
        answers = answers.select(
            "genre",
            "year",
            F.lit("member").alias("role"),
            F.lit(0).cast("bigint").alias("lo"),
            (F.col("n_silent") - 1).cast("bigint").alias("hi"),
            F.col("member").alias("key"),
            F.col("member").alias("display"),
            F.col("member").alias("order_key"),
            F.lit(None).cast("string").alias("last_name"),
        )
    else:
        answers = answers.withColumn("role", F.lit("winner"))
        if _kind(template_id) == fixed.CATEGORICAL:
            answers = answers.drop("k")
    columns = ("role", "lo", "hi", "key", "display", "order_key", "last_name")
    return _identified(answers, template_id, *columns)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def fill(text: str, values: dict[str, str]) -> str:
    """SQL for a text template with its ``{name}`` fields filled in."""
    parts = []
    for literal, name, _, _ in Formatter().parse(text):
        if literal:
            parts.append(_literal(literal))
        if name:
            parts.append(f"cast({values[name]} as string)")
    return f"concat({', '.join(parts)})"


def _rendered(summary: DataFrame, weights: dict[str, int], choices: Choices) -> DataFrame:
    """Task rows from one row per task: params, value, n_truth, winners.

    ``weights``: how often each template was named.
    """
    chosen = list(weights)
    values = {name: f"params.{name}" for name in PARAMS} | {
        "winners": "winners",
        "count": "coalesce(cast(value as bigint), n_truth)",
        "value": "value_text",
    }

    def by_template(of: Callable[[str], object]) -> str:
        cases = " ".join(f"when {_literal(name)} then {of(name)}" for name in chosen)
        return f"case template_id {cases} end"

    text = lambda part: by_template(lambda name: fill(fixed.TEMPLATES[name][part], values))
    constant = lambda part: by_template(lambda name: _literal(fixed.TEMPLATES[name][part]))
    exact = lambda name: _kind(name) == fixed.NUMERIC and name != "total_revenue_in_year"
    tolerance = lambda count, money: by_template(
        lambda name: f"cast({count if exact(name) else money} as double)"
    )
    one = by_template(lambda name: "1" if _kind(name) == fixed.CATEGORICAL else "0")
    return summary.withColumn("value_text", cents_text(F.col("value"))).selectExpr(
        "task_id",
        "template_id",
        f"{constant('difficulty')} as difficulty",
        "to_json(params) as params_json",
        f"{text('question')} as question",
        f"{text('answer_format')} as answer_format",
        f"concat({text('question')}, {_literal(fixed.BEFORE_FORMAT)}, {text('answer_format')}) as prompt",
        f"{constant('answer_type')} as answer_type",
        f"coalesce(params.k, {one}) as k",
        "cast(value as double) as value",
        f"{tolerance(fixed.COUNT_ABS_TOL, fixed.MONEY_ABS_TOL)} as abs_tol",
        f"{tolerance(fixed.COUNT_REL_TOL, fixed.MONEY_REL_TOL)} as rel_tol",
        f"{text('notes')} as notes",
        "cast(n_truth as int) as n_truth",
        f"{by_template(lambda name: f'{weights[name]} * {_ticks(name, choices)}')} as ticks",
    )


def _ticks(template_id: str, choices: Choices) -> str:
    """SQL for the weight of one choice of parameters."""
    return f"cast({TICKS} div ({REGISTRY[template_id].among(choices)}) as bigint)"


def build_tasks(
    star: Star,
    template_ids: Sequence[str] | None = None,
    difficulties: Sequence[str] | None = None,
    reuse: bool = True,
) -> TaskSet:
    """Tasks, truth and candidate universe of the chosen templates.

    Everything is written to the shared folder once, aggregates included, so
    that draws, grading and reports start from small tables.  With ``reuse``
    what this session has written from the same tables is read again.
    """
    weights = Counter(chosen_templates(template_ids, difficulties))
    chosen = list(weights)
    star = with_stored_aggregates(replace(star, reuse=reuse), {n for name in chosen for n in REGISTRY[name].needs})
    choices = Choices(star)
    numeric = [name for name in chosen if _kind(name) == fixed.NUMERIC]
    listed = [name for name in chosen if _kind(name) != fixed.NUMERIC]
    answers = {name: REGISTRY[name].answers(star, choices) for name in chosen}
    summaries = [
        _identified(
            answers[name],
            name,
            F.col("value").cast("decimal(38,2)").alias("value"),
            F.lit(0).cast("bigint").alias("n_truth"),
            F.lit(None).cast("string").alias("winners"),
        )
        for name in numeric
    ]
    if listed:
        found = _union([_entities(answers[name], name) for name in listed])
    else:
        found = _entities(questions.top_genre_in_country(star), "top_genre_in_country").limit(0)
    aliases = alias_set(F.col("display"), F.col("key"), F.col("last_name"))
    truth = stored(found.withColumn("aliases", aliases).drop("last_name"), "truth", reuse=reuse)
    if listed:
        # Names of tied genres are listed in the notes; no other names are collected.
        genre = F.when(F.col("template_id") == "top_genre_in_country", F.col("display"))
        summaries.append(
            truth.groupBy("template_id", "task_id", "params")
            .agg(
                F.count("*").alias("n_truth"),
                F.array_join(F.array_sort(F.collect_list(genre)), ", ").alias("winners"),
            )
            .withColumn("value", F.lit(None).cast("decimal(38,2)"))
        )
    tasks = _rendered(_union(summaries), weights, choices)
    return TaskSet(
        tasks=stored(tasks, "tasks", reuse=reuse),
        truth=truth.drop("template_id", "params"),
        universe=stored(genre_candidates(star), "universe", reuse=reuse),
    )


def genre_candidates(star: Star) -> DataFrame:
    return questions.genre_universe(star).select(
        F.lit("top_genre_in_country").alias("template_id"),
        F.col("genre_name").alias("key"),
        F.col("genre_name").alias("display"),
        alias_set(F.col("genre_name")).alias("aliases"),
    )


def flat_entities(truth: DataFrame) -> DataFrame:
    """Truth with one row per entity and alias."""
    return truth.withColumn("alias", F.explode("aliases")).drop("aliases")


def param_grid(star: Star) -> DataFrame:
    """Every parameter value of every template with its weight, viable or not."""
    choices = Choices(star)
    each_year = F.explode(F.array(*[F.lit(y) for y in choices.years]))
    each_k = F.explode(F.array(*[F.lit(k) for k in fixed.TOP_KS]))
    countries = star.customer.select("country").filter("country is not null").distinct()
    genres = questions.genre_universe(star).select(F.col("genre_name").alias("genre"))
    years = questions.year_row(dated_revenue(star)).select(F.explode("years").alias("year"))
    genre_years = genres.withColumn("year", each_year)
    year_ks = years.withColumn("k", each_k)
    pairs = (
        years.withColumnRenamed("year", "year_a")
        .withColumn("year_b", each_year)
        .filter("year_b > year_a")
        .withColumn("k", each_k)
    )
    frames = {
        "customer_count_in_country": countries,
        "total_revenue_in_year": years,
        "tracks_sold_in_genre_year": genre_years,
        "top_customers_by_revenue": year_ks,
        "top_artists_by_revenue": year_ks,
        "top_genre_in_country": questions.eligible_countries(star).select("country"),
        "top_countries_by_revenue": year_ks,
        "top_customer_revenue_increase": pairs,
        "artists_with_no_sales_in_year": genre_years,
    }
    rows = [
        _identified(frame, name).select(
            "template_id",
            F.to_json("params").alias("params_json"),
            F.expr(_ticks(name, choices)).alias("ticks"),
        )
        for name, frame in frames.items()
    ]
    return _union(rows)


def describe(task_set: TaskSet) -> DataFrame:
    """Truth as text, line by line: ``task_id, lo, order_key, text``.

    ``5.0`` for a number; ``{A, B}`` for a set, which the rules bound; and for a
    ranking one line per name, ``1. A`` or ``2-3. B (tied)``.  Lines of a task
    are in order of ``lo`` and ``order_key``.  Nothing is gathered that grows
    with a tie, so one rule holds for every size.
    """
    numeric = task_set.tasks.filter(F.col("answer_type") == fixed.NUMERIC).select(
        "task_id", F.lit(0).cast("bigint").alias("lo"), F.lit("").alias("order_key"), cents_text(F.col("value")).alias("text")
    )
    members = task_set.truth.filter(F.col("role") == "member").groupBy("task_id").agg(
        F.array_join(F.array_sort(F.collect_list("display")), ", ").alias("names")
    )
    sets = members.select(
        "task_id", F.lit(0).cast("bigint").alias("lo"), F.lit("").alias("order_key"),
        F.concat(F.lit("{"), "names", F.lit("}")).alias("text"),
    )
    first, last = ((F.col(c) + 1).cast("string") for c in ("lo", "hi"))
    line = F.when(F.col("lo") == F.col("hi"), F.concat(first, F.lit(". "), "display")).otherwise(
        F.concat(first, F.lit("-"), last, F.lit(". "), "display", F.lit(" (tied)"))
    )
    ranked = task_set.truth.filter(F.col("role") == "winner").select("task_id", "lo", "order_key", line.alias("text"))
    return numeric.unionByName(sets).unionByName(ranked)


def describe_text(task_set: TaskSet, names_a_chunk: int = 1000) -> DataFrame:
    """Truth as one text per task, in numbered pieces: ``task_id, chunk, text``.

    ``5.0`` for a number, ``{A, B}`` for a set, ``1. A; 2-3. B | C (tied)`` for a
    ranking: the pieces of a task, joined in order, are its text.  Names are
    numbered over ranges of their order and a piece has ``names_a_chunk`` of
    them, so a tie of any size is neither gathered nor sorted in one task.
    """
    numeric = task_set.tasks.filter(F.col("answer_type") == fixed.NUMERIC).select(
        "task_id", F.lit(0).cast("bigint").alias("chunk"), cents_text(F.col("value")).alias("text")
    )
    sets = (
        task_set.truth.filter(F.col("role") == "member")
        .groupBy("task_id")
        .agg(F.array_join(F.array_sort(F.collect_list("display")), ", ").alias("names"))
        .select("task_id", F.lit(0).cast("bigint").alias("chunk"), F.concat(F.lit("{"), "names", F.lit("}")).alias("text"))
    )
    names = task_set.truth.filter(F.col("role") == "winner").select("task_id", "lo", "hi", "order_key", "key", "display")
    placed = numbered(names, ["task_id"], [F.col("lo"), F.col("order_key"), F.col("key")])
    first, last = ((F.col(c) + 1).cast("string") for c in ("lo", "hi"))
    tied = F.col("hi") > F.col("lo")
    begin = F.concat(
        F.when(F.col("pos") > 0, "; ").otherwise(""), first, F.when(tied, F.concat(F.lit("-"), last)).otherwise(""), F.lit(". ")
    )
    piece = F.concat(
        F.when(F.col("pos") == F.col("lo"), begin).otherwise(" | "),
        "display",
        F.when(tied & (F.col("pos") == F.col("hi")), " (tied)").otherwise(""),
    )
    ranked = (
        placed.select("task_id", F.expr(f"pos div {names_a_chunk}").alias("chunk"), F.struct("pos", piece.alias("text")).alias("piece"))
        .groupBy("task_id", "chunk")
        .agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
        .select("task_id", "chunk", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))
    )
    return numeric.unionByName(sets).unionByName(ranked)
