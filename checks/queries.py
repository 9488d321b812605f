"""Every operator as a query over the driver tables: ``name -> (spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import samples
from checks.samples import table
from starqa import fixed_values as fixed
from starqa.functions.answers import clean_item, parse_list, parse_numeric, strip
from starqa.functions.names import full_name, normalize
from starqa.functions.sqltext import screen, scrub
from starqa.operators import audit
from starqa.operators.draw import draw_from
from starqa.operators.grading import mentions, score_answers
from starqa.operators.joins import duplicate_keys, reconcile
from starqa.operators.ranking import preview, top_k
from starqa.operators.sales import country_genre_revenue, customer_year_revenue, sales_view
from starqa.plans import quality, questions
from starqa.plans.tasks import TaskSet, build_tasks, describe, describe_text, flat_entities, param_grid
from starqa.sources.schemas import ORDERS, TableSpec
from starqa.sources.warehouse import Star, orders_store, read_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def star_query(run: Callable[[Star], DataFrame]) -> Query:
    QUERIES[run.__name__] = lambda spark, folder: run(orders_store(spark, folder))
    return run


@lru_cache(maxsize=8)
def _task_set(application: str, spark: SparkSession, folder: str) -> TaskSet:
    return build_tasks(orders_store(spark, folder))


def task_set(spark: SparkSession, folder: str) -> TaskSet:
    """The task set of a folder, built once per application and then reused."""
    return _task_set(spark.sparkContext.applicationId, spark, folder)


def task_query(run: Callable[[SparkSession, str, TaskSet], DataFrame]) -> Query:
    QUERIES[run.__name__] = lambda spark, folder: run(spark, folder, task_set(spark, folder))
    return run


def money(name: str):
    return F.col(name).cast("double").alias(name)


# ---------------------------------------------------------------- sources


@query
def s1_scan_lineitem(spark, folder):
    return read_tables(spark, folder, ORDERS)["lineitem"]


@query
def s3_table_counts(spark, folder):
    return quality.table_counts(read_tables(spark, folder, ORDERS))


@query
def s4_unexpected_counts(spark, folder):
    """Expectation: as many customers, suppliers and parts as a tenth of the orders."""
    tables = read_tables(spark, folder, ORDERS)
    orders = tables["orders"].agg((F.count("*") / 10).cast("bigint").alias("expected_rows"))
    names = F.array(*[F.lit(n) for n in ("customer", "supplier", "part", "absent")])
    expected = orders.select(F.explode(names).alias("table_name"), "expected_rows")
    return quality.unexpected_counts(quality.table_counts(tables), expected)


@query
def s5_profile(spark, folder):
    profile = quality.profile_tables(read_tables(spark, folder, ORDERS), ORDERS)
    return profile.select(
        "table_name", "position", "column_name", "data_type", "row_count", "distinct_count", "null_count",
        F.coalesce("refers_to", F.lit("")).alias("refers_to"), "is_primary_key",
    )


@query
def s5b_profile_sketch(spark, folder):
    """Distinct counts by sketch, compared with the exact ones, and which columns may be null."""
    tables = read_tables(spark, folder, ORDERS)
    exact = quality.profile_tables(tables, ORDERS)
    sketch = quality.profile_tables(tables, ORDERS, distinct="sketch")
    names = ["table_name", "column_name"]
    both = exact.join(sketch.select(*names, F.col("distinct_count").alias("estimate")), names)
    off = F.abs(F.col("estimate") - F.col("distinct_count"))
    return both.select(
        *names, "nullable", "distinct_count",
        (off <= quality.SKETCH_ERROR * F.col("distinct_count")).alias("within_bound"),
    )


@query
def s5c_sample_rows(spark, folder):
    return quality.sample_rows(read_tables(spark, folder, ORDERS), ORDERS, 3)


@query
def s7_preview(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return preview(orders, fixed.PREVIEW_ROWS, [F.col("o_orderkey")])


# ---------------------------------------------------------------- joins and filters


@star_query
def j1_sales(star):
    return sales_view(star).select(
        "invoice_id", "customer_id", "customer_name", "country", "year", "quarter", "track_id",
        "track_name", "album_title", "artist_name", "genre_name", money("unit_price"),
        money("quantity"), money("revenue"),
    )


@star_query
def j1_sales_strict(star):
    """The same view, its joins checked to be many-to-one, summed by quarter."""
    sales = sales_view(star, strict=True)
    return sales.groupBy("year", "quarter", "country").agg(
        F.count("*").alias("lines"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.count("artist_name").alias("with_artist"),
        F.count("genre_name").alias("with_genre"),
    )


@query
def j2_many_to_one_violations(spark, folder):
    lines = read_tables(spark, folder, ORDERS)["lineitem"]
    return duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


@query
def j6_reconcile(spark, folder):
    """Orders whose number of lines differs from the highest line number."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("counted")
    ).withColumnRenamed("l_orderkey", "o_orderkey")
    stated = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 7).alias("stated")
    )
    return reconcile(stated, lines, "o_orderkey", "stated", "counted", 0)


@query
def j7_country_check(spark, folder):
    """Invoices against customers when the nation key stands in for billing."""
    customers = table(spark, folder, "customer")
    invoices = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("customer_id"),
        (F.col("o_custkey") % 25).cast("int").alias("billing_country"),
    )
    return quality.country_mismatches(
        invoices,
        customers.select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("country")),
    )


@star_query
def j5_zero_filled_year(star):
    """Every customer with its 1997 revenue, 0.00 where it bought nothing."""
    sums = customer_year_revenue(star, 1997).drop("year")
    return star.customer.join(sums, "customer_id", "left").select(
        "customer_id", F.coalesce(F.round("revenue", 2), F.lit(0)).cast("double").alias("revenue")
    )


@star_query
def a4_pivot_years(star):
    """Revenue per country with two years as columns."""
    by_year = questions.country_year_revenue(star)
    pivoted = by_year.groupBy("country").pivot("year", [1996, 1997]).agg(F.sum("revenue"))
    return pivoted.select(
        "country",
        F.round(F.coalesce("1996", F.lit(0)), 2).cast("double").alias("y1996"),
        F.round(F.coalesce("1997", F.lit(0)), 2).cast("double").alias("y1997"),
    )


@star_query
def a6_distinct_values(star):
    """Discovered years, countries and genres."""
    years = star.invoices().select(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value"))
    countries = star.customer.select(F.lit("country").alias("kind"), F.col("country").alias("value"))
    genres = star.genre.select(F.lit("genre").alias("kind"), F.col("genre_name").alias("value"))
    return years.union(countries).union(genres).dropna().distinct()


@star_query
def a7_date_range(star):
    return quality.date_range(star)


@star_query
def p7_threshold(star):
    return questions.eligible_countries(star)


@star_query
def p6_null_dimension(star):
    """Some customers without a country and some parts without a genre: their lines drop out."""
    holed = replace(
        star,
        customer=star.customer.withColumn("country", F.when(F.col("customer_id") % 4 != 0, F.col("country"))),
        track=star.track.withColumn("genre_name", F.when(F.col("track_id") % 6 != 0, F.col("genre_name"))),
    )
    return country_genre_revenue(holed).select(
        "country", "genre_name", F.round("revenue", 2).cast("double").alias("revenue")
    )


@query
def p9_display_names(spark, folder):
    """Names of two parts, of which some are missing."""
    part = lambda i: F.split_part("c_name", F.lit("#"), F.lit(i))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        full_name(
            F.when(F.col("c_custkey") % 5 != 0, part(1)), F.when(F.col("c_custkey") % 7 != 0, part(2))
        ).alias("customer_name"),
    )


@star_query
def a3_country_genre_revenue(star):
    return country_genre_revenue(star).select(
        "country", "genre_name", F.round("revenue", 2).cast("double").alias("revenue")
    )


# ---------------------------------------------------------------- ranking


def _ranked(df: DataFrame, *params: str) -> DataFrame:
    return df.select(*params, "k", "tie_group", "lo", "hi", "key", "display", money("value"))


@star_query
def w3_tie_groups(star):
    """First five customers per year by number of orders, where ties abound."""
    return _ranked(questions.top_customers(star, ks=[5], measure="orders"), "year").drop("k")


@star_query
def w4_rank_bands(star):
    """Positions each tie group of the order ranking may take."""
    ranked = questions.top_customers(star, ks=[3, 5, 10], measure="orders")
    return ranked.groupBy("year", "k", "tie_group", "lo", "hi", money("value")).agg(
        F.count("*").alias("members")
    )


@star_query
def w6_top_k_exact(star):
    valued = questions.country_year_revenue(star, 1998).select(
        "country", F.round("revenue", 2).cast("double").alias("revenue")
    )
    return top_k(valued, [F.desc("revenue"), F.col("country")], 3)


# ---------------------------------------------------------------- the nine questions


@star_query
def q1_count_by_country(star):
    return questions.customer_count_in_country(star)


@star_query
def q2_revenue_by_year(star):
    return questions.total_revenue_in_year(star).select("year", money("value"))


@star_query
def q2b_revenue_in_one_year(star):
    return questions.total_revenue_in_year(star, 1996).select("year", money("value"))


@star_query
def q3_quantity_by_genre_year(star):
    return questions.tracks_sold_in_genre_year(star)


@star_query
def q4_top_customers(star):
    return _ranked(questions.top_customers(star), "year")


@star_query
def q4b_top_customers_by_orders(star):
    return _ranked(questions.top_customers(star, measure="orders"), "year")


@star_query
def q5_top_artists(star):
    return _ranked(questions.top_artists(star), "year")


@star_query
def q6_top_genre_by_country(star):
    return _ranked(questions.top_genre_in_country(star), "country")


@star_query
def u2_losing_genres(star):
    return questions.losing_genres(star)


@star_query
def q7_top_countries(star):
    return _ranked(questions.top_countries(star), "year")


@star_query
def q8_revenue_increase(star):
    return _ranked(questions.revenue_increase(star), "year_a", "year_b")


@star_query
def q9_no_sales(star):
    return questions.no_sales_in_year(star)


@star_query
def j3_catalogue(star):
    return questions.catalogue(star)


# ---------------------------------------------------------------- tasks


@star_query
def t1_param_grid(star):
    return param_grid(star)


@query
def t2_task_table(spark, folder):
    """Built afresh, so that its time is that of the whole job."""
    return build_tasks(orders_store(spark, folder), reuse=False).tasks


@task_query
def t4_draw(spark, folder, tasks):
    """A task for every customer."""
    draws = table(spark, folder, "customer").select(F.col("c_custkey").alias("draw_id"))
    drawn = draw_from(samples.task_slots(tasks), draws, "draw_id", samples.DRAW_SEED)
    return drawn.select("draw_id", "task_id", "template_id", "params_json")


@query
def t5_filtered_tasks(spark, folder):
    """Single-table questions only."""
    chosen = build_tasks(orders_store(spark, folder), difficulties=[fixed.SINGLE_TABLE])
    return chosen.tasks.select("task_id", "template_id", "params_json", "value", "ticks")


@task_query
def t7_describe(spark, folder, tasks):
    return describe(tasks)


@task_query
def t7b_describe_text(spark, folder, tasks):
    return describe_text(tasks, samples.NAMES_A_CHUNK)


@task_query
def t8_flat_entities(spark, folder, tasks):
    return flat_entities(tasks.truth).select("task_id", "role", "lo", "hi", "key", "display", "alias")


# ---------------------------------------------------------------- text


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    turns = table(spark, folder, "conversations").select(
        F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    props = table(spark, folder, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("text")
    )
    # Dealt by key before the costly text work, whatever the size: the files may be few.
    return documents.union(turns).union(props).repartition("kind", "id")


@query
def x1_normalize(spark, folder):
    return _texts(spark, folder).select("kind", "id", normalize(F.col("text")).alias("name"))


@query
def x2_parse_numeric(spark, folder):
    return _texts(spark, folder).select("kind", "id", parse_numeric(F.col("text")).alias("number"))


@query
def x3_parse_list(spark, folder):
    texts = _texts(spark, folder).filter("kind <> 'event'")
    return texts.select("kind", "id", F.posexplode(parse_list(F.col("text"))).alias("pos", "item"))


@query
def x3b_parse_list_json(spark, folder):
    """The event texts that x3 leaves out, and objects and lists of JSON made of each event."""
    events = table(spark, folder, "events").repartition("event_id")
    kinds = {"event": F.col("props")} | {k: F.format_string(t, "event_id", "event_type", "user_id") for k, t in samples.JSON_TEXTS.items()}
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds.items())))
    texts = events.select(F.col("event_id").alias("id"), made.alias("made")).select("id", "made.*")
    return texts.select("kind", "id", F.posexplode(parse_list(F.col("text"))).alias("pos", "item"))


@query
def x4_clean_item(spark, folder):
    lines = table(spark, folder, "documents").repartition("doc_id").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    return lines.select("doc_id", "pos", clean_item(F.col("line")).alias("item"))


@query
def x7_mentions(spark, folder):
    """Which benchmark words each document mentions."""
    names = table(spark, folder, "benchmark").select(
        F.explode(F.array_distinct(F.split(normalize(F.col("text")), " "))).alias("key")
    ).distinct()
    return mentions(
        table(spark, folder, "documents").repartition("doc_id"), "doc_id", "text",
        names.withColumn("aliases", F.array("key")),
    )


@query
def x7b_long_mentions(spark, folder):
    """Which benchmark items' beginnings and endings, of one to five words, each document mentions."""
    words = F.split(normalize(F.col("text")), " ")
    ends = [F.array_join(F.slice(words, 1, n), " ") for n in (2, 3, 5)] + [F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), n), " ") for n in (1, 4)]
    names = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.array(*ends).alias("aliases"))
    return mentions(table(spark, folder, "documents").repartition("doc_id"), "doc_id", "text", names)


# ---------------------------------------------------------------- grading


def _graded(spark: SparkSession, folder: str, tasks: TaskSet, kind: str | None) -> DataFrame:
    wanted = tasks.tasks if kind is None else tasks.tasks.filter(F.col("answer_type") == kind)
    answers = samples.drawn_answers(spark, folder, tasks).join(
        wanted.select("task_id"), "task_id", "left_semi"
    )
    graded = score_answers(answers, tasks.tasks, tasks.truth, tasks.universe)
    return graded.select("answer_id", "task_id", "answer_type", F.round("score", 9).alias("score"))


@task_query
def g0_all_scores(spark, folder, tasks):
    return _graded(spark, folder, tasks, None)


@task_query
def g1_numeric(spark, folder, tasks):
    return _graded(spark, folder, tasks, fixed.NUMERIC)


@task_query
def g2_set(spark, folder, tasks):
    return _graded(spark, folder, tasks, fixed.ENTITY_SET)


@task_query
def g3_categorical(spark, folder, tasks):
    return _graded(spark, folder, tasks, fixed.CATEGORICAL)


@task_query
def g4_ranked(spark, folder, tasks):
    return _graded(spark, folder, tasks, fixed.RANKED_LIST)


@query
def g4b_ranked_shared_alias(spark, folder):
    """Customers answered by market segment, an alias that many of them share."""
    star = orders_store(spark, folder, last_name="c_mktsegment")
    tasks = build_tasks(star, ["top_customers_by_revenue"])
    ranked = tasks.tasks.select("task_id")
    customers = table(spark, folder, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("customers")
    )
    segments = customers.agg(
        F.array_join(F.array_sort(F.collect_list("c_mktsegment")), "\n").alias("answer")
    )
    answers = ranked.withColumn("answer", segments.scalar()).withColumn("answer_id", F.col("task_id"))
    return score_answers(answers, tasks.tasks, tasks.truth, tasks.universe)


# ---------------------------------------------------------------- query log


@query
def l1_scrub(spark, folder):
    log = samples.sql_log(spark, folder)
    return log.select("query_id", scrub(F.col("sql")).alias("scrubbed"))


@query
def l1b_scrub_documents(spark, folder):
    documents = table(spark, folder, "documents").repartition("doc_id")
    return documents.select("doc_id", scrub(F.col("text")).alias("scrubbed"))


@query
def l5_verdict(spark, folder):
    screened = screen(samples.sql_log(spark, folder))
    return screened.select(
        "query_id", "n_statements", "leading_keyword", "reason",
        F.array_join("denied", ",").alias("denied"), "message",
    )


@query
def l6_read_audit(spark, folder):
    audited = audit.read_audit(samples.read_events(spark, folder))
    pairs = F.transform("columns_read", lambda c: F.concat(c["table"], F.lit("."), c["column"]))
    return audited.select(
        "query_id",
        F.array_join("tables_read", ",").alias("tables_read"),
        F.array_join(pairs, ",").alias("columns_read"),
        F.array_join("metadata_tables_read", ",").alias("metadata_tables_read"),
        "touched_real_tables",
    )


@query
def l7_grounded(spark, folder):
    return audit.grounded(
        samples.sql_log(spark, folder).select("query_id"), samples.read_events(spark, folder)
    )


@query
def l8_outcome_summary(spark, folder):
    return audit.outcome_summary(samples.outcome_log(spark, folder))


# ---------------------------------------------------------------- data quality


@query
def v1_repeated_keys(spark, folder):
    """Declared keys, and order lines by order and number, which repeat."""
    tables = read_tables(spark, folder, ORDERS)
    number = F.concat_ws(":", "l_orderkey", "l_linenumber").alias("line_key")
    lines = tables["lineitem"].select(number)
    keyed = TableSpec(schema="line_key string", primary_key="line_key")
    return quality.repeated_keys(tables | {"numbered_lines": lines}, ORDERS | {"numbered_lines": keyed})


@query
def v2_key_mismatches(spark, folder):
    return quality.key_mismatches(read_tables(spark, folder, ORDERS), ORDERS)


@star_query
def v3_unreconciled(star):
    return quality.unreconciled_invoices(star).select(
        "invoice_id", money("stated"), money("computed"), "kind"
    )


@star_query
def v5_years(star):
    return quality.sales_by_year(star)


@star_query
def v6_absent_customers(star):
    return quality.absent_customers(star)


@star_query
def v6b_absent_in_ranking(star):
    """Among the first 200 by change from the first to the last year, those that bought nothing in the first."""
    return quality.absent_in_ranking(star, 200).select("customer_id", "lo", "hi", money("value"))


@task_query
def v7_task_invariants(spark, folder, tasks):
    return quality.incomplete_tasks(tasks)


@task_query
def v7b_injected_faults(spark, folder, tasks):
    return quality.incomplete_tasks(samples.with_faults(tasks))


@task_query
def v8_diversity(spark, folder, tasks):
    draws = table(spark, folder, "customer").select(F.col("c_custkey").alias("draw_id"))
    return quality.draw_diversity(draw_from(samples.task_slots(tasks), draws, "draw_id", samples.DRAW_SEED))


# ---------------------------------------------------------------- SQL constructs


def sql_query(name: str, text: str) -> None:
    """A statement over the driver tables, run as it stands by ``spark.sql``."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        used = [t for t in (*ORDERS, "events") if "{" + t + "}" in text]
        return spark.sql(text, **{t: table(spark, folder, t) for t in used})

    QUERIES[name] = run


SQL_CONSTRUCTS = {
    "n1_case_replace": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS bucket, "
        "replace(o_orderpriority, '-', ' ') AS priority FROM {orders}"
    ),
    "n2_cte_count": (
        "WITH t AS (SELECT o_custkey FROM {orders}) SELECT count(*) AS n FROM t"
    ),
    "n3_join_sum": (
        "SELECT c.c_custkey, c.c_name, "
        "CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * CAST(l.l_quantity AS DECIMAL(6,0))) AS DOUBLE) AS revenue "
        "FROM {customer} c JOIN {orders} o ON o.o_custkey = c.c_custkey "
        "JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey GROUP BY c.c_custkey, c.c_name"
    ),
    "n4_like": (
        "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE 'small%' AND p_brand NOT LIKE '%1' "
        "ORDER BY p_partkey"
    ),
    "n5_rounded_sum_by_year": (
        "SELECT n_name, year(o_orderdate) AS year, "
        "CAST(round(sum(CAST(o_totalprice AS DECIMAL(12,2))), 2) AS DOUBLE) AS total "
        "FROM {orders} JOIN {customer} ON c_custkey = o_custkey "
        "JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_name, year(o_orderdate)"
    ),
}
for _name, _text in SQL_CONSTRUCTS.items():
    sql_query(_name, _text)
