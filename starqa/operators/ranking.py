"""Tie-aware rankings in which no task has to see a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starqa.sources.storage import stored

# Slices a group is split into before it is ranked.  A slice holds the rows of
# one group that hash alike, so even a group with most of the rows is ranked by
# this many tasks.
SLICES = 32


def top_k_with_ties(
    df: DataFrame, by: Sequence[str], value: str, key: str, k: int
) -> DataFrame:
    """Rows that stand among the first ``k`` of their group, ties kept whole.

    Adds ``tie_group`` (1, 2, ...), ``lo`` and ``hi`` (first and last zero-based
    position the row may take), ``covered`` (positions the kept tie groups of
    the group fill; less than ``k`` only if the group is smaller than that) and
    ``best`` (largest value of the group).

    Each slice of a group keeps its own first ``k`` (pruned before the shuffle),
    which includes every row of the group's first ``k``.  Values that many rows
    share are counted, not collected: only the counts, at most ``k`` per slice,
    meet in one task.
    """
    by = list(by)
    sliced = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).withColumn(
        "_slice", F.pmod(F.xxhash64(key), F.lit(SLICES))
    )
    in_slice = Window.partitionBy(*by, "_slice").orderBy(F.desc(value))
    near = (
        sliced.withColumn("_rank", F.rank().over(in_slice))
        .filter(F.col("_rank") <= k)
        .drop("_rank")
    )
    # Looking at the keys as well as counting rows keeps this branch's shuffle the
    # same as the other one's, so that it runs once.  The slices are together
    # already, so counting within them shuffles nothing.
    size = F.when(F.max(key).isNotNull(), F.count("*"))
    counts = near.groupBy(*by, "_slice", value).agg(size.alias("_size"))
    return near.drop("_slice").join(_bands(counts, by, value, k), [*by, value])


# Cells a group is cut into to find a bound for its first ``k`` values.
CELLS = 4096


def cell_bounds(df: DataFrame, by: Sequence[str], value: str, key: str, k: int) -> DataFrame:
    """For each group a value that none of its first ``k`` rows lies below: ``by`` and ``bound``.

    Each cell of a group (its keys by hash) gives its largest value, one number
    however many rows it has.  The k-th largest of these belongs to k different
    keys, so no row below it can be among the first k.  Null for a group with
    fewer than k cells.  ``key`` is unique within a group.
    """
    by = list(by)
    cell = F.pmod(F.xxhash64(key), F.lit(CELLS)).alias("_cell")
    best = df.groupBy(*by, cell).agg(F.max(value).alias("_best"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_best")))
    placed = best.withColumn("_place", place).filter(F.col("_place") <= k)
    return placed.groupBy(*by).agg(F.max(F.when(F.col("_place") == k, F.col("_best"))).alias("bound"))


def possible_top(df: DataFrame, by: Sequence[str], value: str, key: str, k: int) -> DataFrame:
    """The rows that may stand among the first ``k`` of their group, found without sorting it.

    About k rows of each group remain, and those that tie with them; of a group
    with fewer than k cells all.  The rows are read twice.
    """
    by = list(by)
    bounds = cell_bounds(df, by, value, key, k)
    bounds = bounds.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("bound").alias("_bound"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    kept = df.join(bounds, same).filter(F.col("_bound").isNull() | (F.col(value) >= F.col("_bound")))
    return kept.select(*df.columns)


def _bands(counts: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """Position band of each distinct value that starts before position ``k``."""
    down = Window.partitionBy(*by).orderBy(F.desc(value))
    upto = down.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = down.rangeBetween(Window.currentRow, Window.currentRow)
    group = Window.partitionBy(*by)
    return (
        counts.withColumn("hi", F.sum("_size").over(upto) - 1)
        .withColumn("lo", F.col("hi") + 1 - F.sum("_size").over(equal))
        .withColumn("tie_group", F.dense_rank().over(down))
        .filter(F.col("lo") < k)
        .withColumn("covered", F.max("hi").over(group) + 1)
        .withColumn("best", F.max(value).over(group))
        .drop("_slice", "_size")
        .distinct()
    )


def for_each_k(ranked: DataFrame, ks: Sequence[int], needs: Column | None = None) -> DataFrame:
    """One ranking per ``k`` out of a ranking taken at the largest of them.

    A group with fewer than ``k`` entities has no ranking for that ``k``.
    """
    rows = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    kept = (F.col("lo") < F.col("k")) & (F.col("covered") >= F.col("k"))
    return rows.filter(kept if needs is None else kept & needs)


def winners(df: DataFrame, by: Sequence[str], value: str, key: str) -> DataFrame:
    """Rows that share the largest value of their group."""
    return top_k_with_ties(df, by, value, key, 1)


def first_per_group(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """Exactly the first ``n`` rows of each group under a full ordering.

    Adds ``pos``, zero-based.  Pruned before the shuffle.
    """
    place = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("pos", F.row_number().over(place) - 1).filter(F.col("pos") < n)
    )


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """All rows of every group numbered from 0 in a full ordering: adds ``pos``.

    No task has to see a whole group: rows are dealt out by ranges of the
    ordering and written once; a row's number is its place in its range and the
    rows of its group in earlier ranges, of which there is one count each.
    """
    by = list(by)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = [*[F.col(c) for c in by], *order]
    placed = df.repartitionByRange(parts, *line).sortWithinPartitions(*line)
    rows = stored(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    starts = runs.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_part").alias("_run"), "_first", "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] + [F.col("_part") == F.col("_run")]
    return rows.join(starts, same).select(*df.columns, F.expr("_before + _at - _first").alias("pos"))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Exactly ``k`` rows under a full ordering."""
    return df.orderBy(*order).limit(k)


def preview(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows, flagged with whether more existed."""
    head = df.orderBy(*order).limit(n + 1)
    everything = Window.partitionBy(F.lit(1))
    return (
        head.withColumn("_pos", F.row_number().over(everything.orderBy(*order)))
        .withColumn("truncated", F.count("*").over(everything) > n)
        .filter(F.col("_pos") <= n)
        .drop("_pos")
    )
