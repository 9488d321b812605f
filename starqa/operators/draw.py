"""Seeded weighted draws with replacement, from an alias table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starqa.sources.storage import stored

# Hash buckets the running totals are taken in; only their sums meet in one task.
BUCKETS = 256
HASH_DIGITS = 15
# Sums of up to 10^18 ticks times up to 10^12 items.
WIDE = "decimal(38,0)"


def uniform(seed: int, draw_id: Column, part: int = 0) -> Column:
    """A whole number below ``16**HASH_DIGITS``, fixed by seed, draw and part (0 or 1)."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), draw_id.cast("string")))
    digits = F.substring(digest, 1 + part * HASH_DIGITS, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


def _share(seed: int, draw_id: Column, part: int, size: Column) -> Column:
    """A whole number below ``size``."""
    span = F.lit(16**HASH_DIGITS).cast("decimal(20,0)")
    whole = (uniform(seed, draw_id, part) * size.cast("decimal(18,0)")).cast(WIDE)
    return F.call_function("div", whole, span.cast(WIDE))


def _with_totals(items: DataFrame, key: str, ticks: str) -> DataFrame:
    """Adds to each item its slot, and how much it and all before it lack or have to spare.

    With n items a slot holds the n-th part of all ticks; everything is
    multiplied by n, so that it stays whole: an item has ``ticks * n``, a slot
    holds the sum of all ticks.  ``lacks`` and ``spares`` are running totals in
    the order of a hash of the key and then the key.
    """
    kept = items.filter(F.col(ticks) > 0)
    n, total = (kept.agg(a).scalar().cast(WIDE) for a in (F.count("*"), F.sum(ticks)))
    bucket = F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int")
    over = (F.col("_scaled") - F.col("_full")).cast(WIDE)
    sized = (
        kept.select(F.struct(*[c for c in items.columns if c != ticks]).alias("own"), F.col(key).alias("_key"),
                    bucket.alias("_bucket"), (F.col(ticks).cast("decimal(18,0)") * n).cast(WIDE).alias("_scaled"), total.alias("_full"))
        .withColumn("_heavy", F.col("_scaled") >= F.col("_full"))
        .withColumn("_spare", F.greatest(over, F.lit(0).cast(WIDE)))
        .withColumn("_lack", F.greatest((-over).cast(WIDE), F.lit(0).cast(WIDE)))
    )
    sums = sized.groupBy("_bucket").agg(
        F.count("*").alias("_rows"), *(F.sum(c).cast(WIDE).alias(f"{c}_sum") for c in ("_spare", "_lack"))
    )
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket",
        *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast(WIDE).alias(f"{c}_before") for c in ("_rows", "_spare_sum", "_lack_sum")),
    )
    within = Window.partitionBy("_bucket").orderBy("_key")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sized.select("*", F.row_number().over(within).alias("_row"), *(F.sum(c).over(upto).cast(WIDE).alias(f"{c}_upto") for c in ("_spare", "_lack")))
    return running.join(offsets, "_bucket").select(
        "own", "_key", "_bucket", "_scaled", "_full", "_heavy", "_lack",
        (F.col("_rows_before") + F.col("_row") - 1).cast("bigint").alias("slot"),
        (F.col("_spare_sum_before") + F.col("_spare_upto")).cast(WIDE).alias("_spares"),
        (F.col("_lack_sum_before") + F.col("_lack_upto")).cast(WIDE).alias("_lacks"),
    )


def alias_table(items: DataFrame, key: str, ticks: str) -> DataFrame:
    """One row per item with ticks: ``slot``, ``own``, ``other``, ``threshold`` and ``full``.

    A slot is chosen evenly; it gives its own item below ``threshold`` (of
    ``full``) and the other one above.  ``own`` and ``other`` have all columns of
    the item but its ticks.

    Light items lack something to fill their slot, heavy ones have it to spare.
    Laid end to end in one order, what is lacked and what is spared are the same
    line: a light item is filled by the first heavy one whose end lies beyond its
    own beginning.  The light item in which a heavy one ends takes the rest from
    the heavy one's own slot, which the next heavy one fills.  So both sides
    sorted together by place give every partner, whatever the weights are: the
    sort is a range partitioning, and only a row per partition meets in one task.
    """
    totals = _with_totals(items, key, ticks)
    begin = (F.col("_lacks") - F.col("_lack")).cast(WIDE)
    # Where places are equal the heavy item comes first: it ends before the light one begins.
    line = totals.withColumn("_place", F.when(F.col("_heavy"), F.col("_spares")).otherwise(begin))
    order = [F.col("_place"), F.desc("_heavy"), F.col("_bucket"), F.col("_key")]
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = line.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "alias-line")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))

    heavy = F.when(F.col("_heavy"), F.col("own"))
    light_end = F.when(~F.col("_heavy"), F.col("_lacks"))
    # Running backwards, since a frame that has no end is read anew for every row.
    after = Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part").agg(
        F.min_by(heavy, F.when(F.col("_heavy"), F.col("_at"))).alias("_first"), F.max(light_end).alias("_last")
    )
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sooner = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "_part",
        F.last("_first", ignorenulls=True).over(later).alias("_heavy_after"),
        F.max("_last").over(sooner).alias("_light_before"),
    )
    met = rows.select(
        "*", F.last(heavy, ignorenulls=True).over(after).alias("_heavy_in"), F.max(light_end).over(before).alias("_light_in")
    ).join(carried, "_part")
    taken = F.coalesce(F.greatest("_light_in", "_light_before") - F.col("_spares"), F.lit(0)).cast(WIDE)
    threshold = F.when(F.col("_heavy"), F.col("_full") - F.greatest(taken, F.lit(0).cast(WIDE))).otherwise(F.col("_scaled"))
    table = met.select(
        "slot", "own", F.coalesce("_heavy_in", "_heavy_after", "own").alias("other"),
        threshold.cast("bigint").alias("threshold"), F.col("_full").cast("bigint").alias("full"),
    )
    return stored(table, "alias-table")


def draw_from(table: DataFrame, draws: DataFrame, draw_id: str, seed: int) -> DataFrame:
    """The draws, each with the columns of the item it drew.

    A draw is one row and finds one row of the table; draws fall evenly over the
    slots.  Fails when there is nothing to draw from.
    """
    n, full = (F.coalesce(table.agg(a).scalar(), F.lit(0)) for a in (F.count("*"), F.max("full")))
    fail = F.raise_error(F.lit("Could not draw a task: none is viable.")).cast("boolean")
    placed = (
        draws.filter(F.when(n == 0, fail).otherwise(F.lit(True)))
        .withColumn("_slot", _share(seed, F.col(draw_id), 0, n))
        .withColumn("_rest", _share(seed, F.col(draw_id), 1, full))
    )
    # Every draw has its slot; one without an id has none, and draws nothing.
    drawn = placed.join(table, F.col("_slot") == F.col("slot"), "left")
    item = F.when(F.col("_rest") < F.col("threshold"), F.col("own")).otherwise(F.col("other"))
    fields = table.schema["own"].dataType.names
    return drawn.withColumn("_item", item).select(*draws.columns, *(F.col("_item")[f].alias(f) for f in fields))


def weighted_draw(
    draws: DataFrame, draw_id: str, items: DataFrame, key: str, ticks: str, seed: int
) -> DataFrame:
    """One item for each draw, with probability proportional to its ticks.

    Draws that start from the same items more than once keep the table
    (:func:`alias_table`) and use :func:`draw_from`.
    """
    return draw_from(alias_table(items, key, ticks), draws, draw_id, seed)


def numbered_draws(spark: SparkSession, n: int) -> DataFrame:
    """Draw ids 0 to n - 1."""
    return spark.range(n).withColumnRenamed("id", "draw_id")
