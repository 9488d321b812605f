"""Joins that state and check how many rows may match."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unique_on(df: DataFrame, key: str) -> DataFrame:
    """The same rows, failing the job if ``key`` repeats (nulls do not count).

    One value, the least key that repeats, is looked up once and compared by
    every row; the rows stay as they are, so a join that follows is a plain
    one and Spark can split its hot keys.
    """
    least = duplicate_keys(df.filter(F.col(key).isNotNull()), key).agg(F.min(key).cast("string"))
    message = F.concat(F.lit(f"many-to-one join: {key} repeats: "), least.scalar())
    # The message is null, and the filter true, if no key repeats.
    return df.filter(F.when(message.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def join_many_to_one(
    left: DataFrame, right: DataFrame, key: str, strict: bool = False
) -> DataFrame:
    """Left join in which each left row finds at most one right row.

    ``strict`` verifies it inside the job; otherwise check ahead with
    :func:`duplicate_keys`.
    """
    return left.join(unique_on(right, key) if strict else right, key, "left")


def reconcile(
    left: DataFrame, right: DataFrame, key: str, left_value: str, right_value: str, tolerance: float
) -> DataFrame:
    """Keys on which two totals disagree, or that only one side has."""
    both = left.join(right, key, "full_outer")
    difference = F.abs(F.col(left_value) - F.col(right_value))
    kind = (
        F.when(F.col(left_value).isNull(), f"no {left_value}")
        .when(F.col(right_value).isNull(), f"no {right_value}")
        .when(difference > F.lit(tolerance), "mismatch")
    )
    return both.withColumn("kind", kind).filter(F.col("kind").isNotNull())
