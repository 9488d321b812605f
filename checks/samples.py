"""Derived inputs: tables the operators need that the driver tables do not hold.

Each is a rule over a whole driver table, stated once as SQL text that Spark
and DuckDB read alike.
"""

from __future__ import annotations

from dataclasses import replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starqa import fixed_values as fixed
from starqa.functions.money import cents_text
from starqa.operators.draw import alias_table, draw_from
from starqa.operators.ranking import first_per_group
from starqa.plans.tasks import TaskSet

DRAW_SEED = 7
VARIANTS = 8

Q = "chr(39)"  # a single quote
NL = "chr(10)"

# One statement per order, its shape chosen by the order key.
LOGGED_SQL = f"""
CASE o_orderkey % 20
  WHEN 0 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey
  WHEN 1 THEN 'DROP TABLE orders'
  WHEN 2 THEN 'DELETE FROM customer WHERE c_custkey = ' || o_custkey
  WHEN 3 THEN 'SELECT ' || o_orderkey || '; DROP TABLE customer'
  WHEN 4 THEN 'SELECT 1;' || {NL} || '-- innocuous' || {NL} || 'DROP TABLE customer'
  WHEN 5 THEN 'WITH t AS (SELECT ' || o_orderkey || ') INSERT INTO genre SELECT 99'
  WHEN 6 THEN 'SELECT load_extension(' || {Q} || '/tmp/' || o_orderkey || '.so' || {Q} || ')'
  WHEN 7 THEN 'SELECT ' || {Q} || 'DROP TABLE ' || o_orderkey || {Q} || ' AS harmless'
  WHEN 8 THEN '-- only a comment about ' || o_orderkey
  WHEN 9 THEN '   '
  WHEN 10 THEN '/* update' || {NL} || ' later */ select "drop", [delete], `vacuum` from t -- create'
  WHEN 11 THEN 'SELECT ' || {Q} || 'it' || {Q} || {Q} || 's; ' || o_orderkey || {Q} || ' ; '
  WHEN 12 THEN 'EXPLAIN QUERY PLAN SELECT * FROM customer'
  WHEN 13 THEN 'VALUES (' || o_orderkey || ')'
  WHEN 14 THEN 'PRAGMA writable_schema = ON'
  WHEN 15 THEN 'SELECT readfile(' || {Q} || 'a' || {Q} || '), writefile(' || {Q} || 'b' || {Q} || ')'
  WHEN 16 THEN cast(o_orderkey AS varchar(20)) || ' ; '
  WHEN 17 THEN 'SELECT ' || {Q} || 'a -- b' || {Q} || ' ; DROP TABLE t'
  WHEN 18 THEN 'SELECT CASE WHEN x > 5 THEN 1 END, replace(a, b, c) FROM t; ;'
  ELSE 'update orders set o_orderstatus = ' || {Q} || o_orderstatus || {Q}
END
"""

# One read per event: the user is the query.
READ_TABLE = """
CASE event_type
  WHEN 'view' THEN 'customer'
  WHEN 'click' THEN 'orders'
  WHEN 'purchase' THEN CASE WHEN user_id % 3 = 0 THEN 'sqlite_schema' ELSE 'lineitem' END
  WHEN 'signup' THEN 'SQLITE_master'
  ELSE ''
END
"""
READ_COLUMN = """
CASE event_id % 4
  WHEN 0 THEN ''
  WHEN 1 THEN 'key'
  WHEN 2 THEN 'value_' || cast(event_id % 7 AS varchar(5))
  ELSE NULL
END
"""
# One outcome per event.
ERROR_TYPE = "CASE event_id % 9 " + " ".join(
    f"WHEN {i} THEN '{slug}'" for i, slug in enumerate(fixed.ERROR_TYPES)
) + " END"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_log(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").repartition("o_orderkey")
    return orders.select(F.col("o_orderkey").alias("query_id"), F.expr(LOGGED_SQL).alias("sql"))


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("query_id"),
        F.expr(READ_TABLE).alias("table"),
        F.expr(READ_COLUMN).alias("column"),
    )


def outcome_log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("query_id"),
        F.expr("event_type <> 'error'").alias("ok"),
        F.expr(ERROR_TYPE).alias("error_type"),
        F.expr("event_id % 61").alias("row_count"),
        F.expr("event_id % 61 > 50").alias("truncated"),
        F.col("value").alias("elapsed_s"),
    )


def answer_variants(task_set: TaskSet) -> DataFrame:
    """Eight ways of answering each task, right and wrong: task_id, variant, answer."""
    tasks = task_set.tasks
    money = cents_text(F.col("value"))
    more = cents_text(F.col("value").cast("decimal(38,2)") + 1)
    near = (F.col("value").cast("decimal(18,2)") * F.lit(1.0005).cast("decimal(5,4)")).cast("string")
    numeric_texts = F.array(
        money,
        F.concat(F.lit("$"), money),
        F.concat(F.lit('{"total": '), money, F.lit("}")),
        more,
        F.concat(F.lit("The total was "), money, F.lit(" dollars.")),
        F.concat(F.lit("either "), money, F.lit(" or 7")),
        near,
        F.lit(""),
    )
    numeric = tasks.filter(F.col("answer_type") == fixed.NUMERIC).select(
        "task_id", F.posexplode(numeric_texts).alias("variant", "answer")
    )
    # An answer has as many names as the task asks for: k, or all of a set.
    wanted = tasks.select(
        "task_id", F.when(F.col("k") > 0, F.col("k")).otherwise(F.col("n_truth")).alias("wanted")
    )
    first = first_per_group(
        task_set.truth.select("task_id", "lo", "order_key", "display"),
        ["task_id"],
        [F.col("lo"), F.col("order_key")],
        fixed.MAX_SET_ANSWERS,
    )
    names = (
        first.join(wanted, "task_id")
        .filter("pos < wanted")
        .groupBy("task_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "display"))).alias("placed"))
        .select("task_id", F.transform("placed", lambda p: p["display"]).alias("names"))
    )
    numbered = lambda note: F.array_join(
        F.transform(
            "names",
            lambda n, i: F.concat((i + 1).cast("string"), F.lit(". "), n, F.lit(note)),
        ),
        "\n",
    )
    one = F.get("names", F.lit(0))
    listed_texts = F.array(
        numbered(""),
        F.array_join("names", ", "),
        F.concat(F.lit('["'), F.array_join("names", '", "'), F.lit('"]')),
        F.array_join(F.reverse("names"), "\n"),
        numbered(" ($49.62)"),
        F.concat(F.lit("- "), one),
        F.concat(F.lit("The answer is "), one, F.lit(".")),
        F.concat(one, F.lit("\n"), one, F.lit("\nZed")),
    )
    listed = names.select("task_id", F.posexplode(listed_texts).alias("variant", "answer"))
    return numeric.unionByName(listed)


@lru_cache(maxsize=8)
def task_slots(task_set: TaskSet) -> DataFrame:
    """The alias table of a task set, built once and then drawn from."""
    items = task_set.tasks.select("task_id", "template_id", "difficulty", "params_json", "question", "ticks")
    return alias_table(items, "task_id", "ticks")


def drawn_answers(spark: SparkSession, folder: str, task_set: TaskSet) -> DataFrame:
    """One answer per order, to a drawn task: answer_id, task_id, variant, answer."""
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("answer_id")).repartition("answer_id")
    drawn = draw_from(task_slots(task_set), orders, "answer_id", DRAW_SEED).select(
        "answer_id", "task_id", (F.col("answer_id") % VARIANTS).cast("int").alias("variant")
    )
    return drawn.join(answer_variants(task_set), ["task_id", "variant"])


#: Names in a piece of a described ranking.
NAMES_A_CHUNK = 2


def with_faults(task_set: TaskSet) -> TaskSet:
    """The task set with one fault of each kind, put in by a hash of the task.

    ``0``, ``1``: no value, or no truth at all; ``2``, ``3``: the last band of a
    ranking or the last name of a set is missing; ``4``, ``5``: one entity more is
    claimed.  All others stay right.
    """
    digit = F.substring(F.md5("task_id"), 1, 1)
    tasks = task_set.tasks.withColumn("value", F.when(~digit.isin("0", "1"), F.col("value"))).withColumn(
        "n_truth", F.col("n_truth") + F.when(digit.isin("4", "5"), 1).otherwise(0)
    )
    last = task_set.truth.groupBy("task_id").agg(F.max(F.struct("lo", "order_key", "key")).alias("_last"))
    truth = task_set.truth.join(last, "task_id").filter(~digit.isin("0", "1"))
    gone = F.when(F.col("role") == "member", F.col("key") == F.col("_last.key")).otherwise(F.col("lo") == F.col("_last.lo"))
    return replace(task_set, tasks=tasks, truth=truth.filter(~(digit.isin("2", "3") & gone)).drop("_last"))


#: JSON texts by kind, of an event's id, type and user.
JSON_TEXTS = {
    "object": '{"k": %d, "in": {"a": [1]}, "names": ["1. %s", "", " %d (note)", null, true, 7, "a, b"], "more": ["x"]}',
    "array": '["%d", "%s", [1], %d, false]',
    "no list": '{"k": %d, "name": "%s, %d"}',
}
