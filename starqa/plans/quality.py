"""Data-quality reports over a warehouse layout, a star or a task set.

Each report lists what is wrong; an empty result means the check passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starqa import fixed_values as fixed
from starqa.functions.money import round_cents
from starqa.operators.joins import reconcile
from starqa.operators.sales import invoice_revenue
from starqa.plans import questions
from starqa.plans.tasks import TaskSet
from starqa.sources.schemas import TableSpec
from starqa.sources.storage import stored
from starqa.sources.warehouse import Star


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table."""
    return _union(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()
        ]
    )


def unexpected_counts(counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected tables that are missing, empty or of another size.

    ``expected`` has table_name and expected_rows.
    """
    both = expected.join(counts, "table_name", "left")
    kind = (
        F.when(F.col("row_count").isNull(), "missing")
        .when(F.col("row_count") == 0, "empty")
        .when(F.col("row_count") != F.col("expected_rows"), "other size")
    )
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull())


#: log2 of a sketch's size, and how far its estimate may be off: six standard errors of 1.04 / 2^(n/2).
SKETCH_BITS, SKETCH_ERROR = 14, 0.05


def profile_tables(
    tables: dict[str, DataFrame], layout: dict[str, TableSpec], distinct: str = "exact"
) -> DataFrame:
    """One row per table and column: type, keys, row count, null count, nullability, distinct count.

    Rows and nulls are counted in one pass over each table.  ``distinct`` is
    ``"exact"``: each column is read by itself and made distinct within each task
    before it is sent; or ``"sketch"``: sketches of all columns (HyperLogLog, 2^14
    registers, a standard error of 0.8 %) join the one pass, so what is sent does
    not grow with the table.  A primary key may not be null.
    """
    if distinct not in ("exact", "sketch"):
        raise ValueError(f"Unknown way to count distinct values: {distinct}")
    profiles, counts = [], []
    for name, df in tables.items():
        spec = layout[name]
        targets = {column: f"{table}({key})" for column, table, key in spec.foreign_keys}
        fields = df.schema.fields
        sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(SKETCH_BITS)))
        counted = df.agg(
            F.count("*").alias("row_count"),
            *[F.count_if(F.col(f.name).isNull()).alias(f"nulls_{i}") for i, f in enumerate(fields)],
            *[sketch(f.name).alias(f"distinct_{i}") for i, f in enumerate(fields) if distinct == "sketch"],
        )
        entries = F.array(
            *[
                F.struct(
                    F.lit(i + 1).alias("position"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.name == spec.primary_key).alias("is_primary_key"),
                    F.lit(targets.get(f.name)).cast("string").alias("refers_to"),
                    F.col(f"nulls_{i}").alias("null_count"),
                    F.lit(f.nullable and f.name != spec.primary_key).alias("nullable"),
                    *([F.col(f"distinct_{i}").alias("distinct_count")] if distinct == "sketch" else []),
                )
                for i, f in enumerate(fields)
            ]
        )
        profiles.append(
            counted.select(F.lit(name).alias("table_name"), "row_count", F.inline(entries))
        )
        counts += [
            df.select(F.col(f.name).alias("value")).filter("value is not null").distinct()
            .agg(F.count("*").alias("distinct_count"))
            .select(F.lit(name).alias("table_name"), F.lit(i + 1).alias("position"), "distinct_count")
            for i, f in enumerate(fields)
        ]
    profile = _union(profiles)
    return profile if distinct == "sketch" else profile.join(_union(counts), ["table_name", "position"])


def sample_rows(tables: dict[str, DataFrame], layout: dict[str, TableSpec], n: int) -> DataFrame:
    """The first ``n`` rows of every table by its key (by all columns, if it has none) as text.

    ``table_name, sample, text``; text is ``column=value`` of each column, strings
    in quotes, nulls as None.  Each task passes on no more than ``n`` rows.
    """
    samples = []
    for name, df in tables.items():
        key = layout[name].primary_key
        order = [F.col(c) for c in ([key] if key else df.columns)]
        shown = [
            F.concat(
                F.lit(f"{f.name}="),
                F.coalesce(F.concat(F.lit("'"), f.name, F.lit("'")) if f.dataType.typeName() == "string" else F.col(f.name).cast("string"), F.lit("None")),
            )
            for f in df.schema.fields
        ]
        first = df.orderBy(*order).limit(n)
        place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))
        samples.append(first.select(F.lit(name).alias("table_name"), place.alias("sample"), F.concat_ws(", ", *shown).alias("text")))
    return _union(samples)


def repeated_keys(tables: dict[str, DataFrame], layout: dict[str, TableSpec]) -> DataFrame:
    """Primary-key values that occur more than once; all tables in one aggregation."""
    tagged = _union(
        [
            tables[name].select(
                F.lit(name).alias("table_name"), F.col(spec.primary_key).cast("string").alias("key")
            )
            for name, spec in layout.items()
            if spec.primary_key
        ]
    )
    return tagged.groupBy("table_name", "key").agg(F.count("*").alias("n")).filter("n > 1")


#: Sides of a reference, as bits.
CHILD, PARENT = 1, 2


def key_mismatches(tables: dict[str, DataFrame], layout: dict[str, TableSpec]) -> DataFrame:
    """Foreign keys without a parent, and parents without a child.

    Every row says of each reference that its table takes part in which key it
    has and on which side; one aggregation over all references joins the sides
    by ``bit_or``, within each task first, so a key that most rows share is sent
    once a task.  Each table is read once.  Keys are compared as text, child
    keys after a cast to the type of the parent's.
    """
    seen: dict[str, list[tuple[str, str, int, str]]] = {}
    for name, spec in layout.items():
        for column, parent, key in spec.foreign_keys:
            reference = f"{name}.{column} -> {parent}.{key}"
            kind = tables[parent].schema[key].dataType.simpleString()
            seen.setdefault(name, []).append((reference, column, CHILD, kind))
            seen.setdefault(parent, []).append((reference, key, PARENT, kind))
    tagged = [
        tables[name].select(
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(reference).alias("reference"),
                            F.col(column).cast(kind).cast("string").alias("key"),
                            F.lit(side).alias("side"),
                        )
                        for reference, column, side, kind in roles
                    ]
                )
            ).alias("role")
        ).select("role.*")
        for name, roles in seen.items()
    ]
    sides = (
        _union(tagged)
        .filter(F.col("key").isNotNull())
        .groupBy("reference", "key")
        .agg(F.bit_or("side").alias("sides"))
        .filter(F.col("sides") != CHILD | PARENT)
    )
    kind = F.when(F.col("sides") == CHILD, "orphan").otherwise("childless")
    return sides.select("reference", kind.alias("kind"), "key")


def unreconciled_invoices(
    star: Star, line_total: str = "revenue", tolerance: float = fixed.RECONCILE_TOL
) -> DataFrame:
    """Invoices whose stated total differs from their lines, either side missing."""
    computed = star.line.groupBy("invoice_id").agg(
        round_cents(F.sum(line_total)).alias("computed")
    )
    stated = star.invoice.select("invoice_id", round_cents(F.col("total")).alias("stated"))
    return reconcile(stated, computed, "invoice_id", "stated", "computed", tolerance)


def country_mismatches(invoices: DataFrame, customers: DataFrame) -> DataFrame:
    """Invoices billed to another country than their customer's.

    ``invoices`` has customer_id and billing_country, ``customers`` customer_id
    and country.  A missing country agrees with none.
    """
    same = F.coalesce(F.col("billing_country") == F.col("country"), F.lit(False))
    return invoices.join(customers, "customer_id").filter(~same)


def date_range(star: Star) -> DataFrame:
    """First and last invoice date."""
    return star.invoice.agg(
        F.min("invoice_date").alias("first_date"), F.max("invoice_date").alias("last_date")
    )


def sales_by_year(star: Star) -> DataFrame:
    """Discovered years with invoices and lines; a year in use has both."""
    return (
        invoice_lines(star)
        .groupBy("year")
        .agg(F.count("*").alias("invoices"), F.sum("lines").cast("bigint").alias("lines"))
    )


def invoice_lines(star: Star) -> DataFrame:
    lines = star.line.groupBy("invoice_id").agg(F.count("*").alias("lines"))
    return star.invoices().select("invoice_id", "year").join(lines, "invoice_id", "left")


def undated_invoices(star: Star) -> DataFrame:
    """Invoices without a date: they belong to no year and need repair."""
    return star.invoice.filter(F.col("invoice_date").isNull())


def absent_customers(star: Star) -> DataFrame:
    """Customers without sales in the first year but with some in the last.

    They take part in the change between the two years, from 0.00.  Lines are
    read once: what is written is a count per customer and year.
    """
    sold = invoice_revenue(star).filter("customer_id is not null and year is not null")
    per_year = stored(
        sold.groupBy("customer_id", "year").agg(F.count("*").alias("invoices")), "customer-year-invoices", reuse=star.reuse
    )
    ends = per_year.agg(F.struct(F.min("year").alias("first"), F.max("year").alias("last"))).scalar()
    in_year = lambda end: F.coalesce(F.sum(F.when(F.col("year") == F.col("_ends")[end], F.col("invoices"))), F.lit(0))
    active = per_year.withColumn("_ends", ends).groupBy("customer_id").agg(
        in_year("first").alias("first_year"), in_year("last").alias("last_year")
    )
    return (
        active.filter("first_year = 0 and last_year > 0")
        .join(star.customer.select("customer_id", "customer_name"), "customer_id", "left")
        .select("customer_id", "customer_name", F.col("last_year").alias("last_year_invoices"))
    )


def absent_in_ranking(star: Star, k: int) -> DataFrame:
    """Absent customers among the first ``k`` by change from the first to the last year.

    ``customer_id, lo, hi, value``: they stand in that ranking although they have
    no row in its first year.
    """
    years = sorted(r.year for r in questions.dated_revenue(star).select("year").distinct().filter("year is not null").collect())
    if not years:
        return absent_customers(star).select("customer_id", F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi"), F.lit(None).cast("decimal(38,2)").alias("value"))
    ranking = questions.revenue_increase(star, [k], years[0], years[-1])
    placed = ranking.select(F.col("key"), "lo", "hi", "value")
    absent = absent_customers(star).select("customer_id", F.col("customer_id").cast("string").alias("key"))
    return absent.join(placed, "key").select("customer_id", "lo", "hi", "value")


def incomplete_tasks(task_set: TaskSet) -> DataFrame:
    """Tasks without truth, or whose bands do not cover ``k`` positions."""
    spans = task_set.truth.groupBy("task_id").agg(
        F.count("*").alias("entities"), (F.max("hi") + 1).alias("covered")
    )
    joined = task_set.tasks.join(spans, "task_id", "left")
    numeric = F.col("answer_type") == fixed.NUMERIC
    problem = (
        F.when(numeric & F.col("value").isNull(), "no value")
        .when(~numeric & F.col("entities").isNull(), "no entities")
        .when(~numeric & (F.col("covered") < F.col("k")), "bands too short")
        .when(~numeric & (F.col("entities") != F.col("n_truth")), "entities miscounted")
    )
    return joined.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(
        "task_id", "template_id", "params_json", "problem"
    )


def draw_diversity(drawn: DataFrame) -> DataFrame:
    """Distinct templates, tiers and questions among drawn tasks."""
    return drawn.agg(
        F.count("*").alias("draws"),
        F.countDistinct("template_id").alias("templates"),
        F.countDistinct("difficulty").alias("tiers"),
        F.countDistinct("question").alias("questions"),
    )
