"""Exact money: decimals inside, half-up cents once at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_money(col: Column) -> Column:
    """A price or rate read as double, as an exact number: six decimals, so nothing is cut to cents.

    What a double has beyond six decimals is its own inexactness: 0.995 is
    stored as 0.99499....  A value too large for it ends the job.
    """
    return col.cast("decimal(18,6)")


def round_cents(col: Column) -> Column:
    """Half-up to cents; apply once, after the aggregation."""
    return F.round(col, 2)


def total(col: Column) -> Column:
    """Sum that is zero, not null, when there is nothing to add."""
    return F.coalesce(F.sum(col), F.lit(0))


def cents_text(col: Column) -> Column:
    """Money as text with at least one decimal: ``5.0``, ``2328.6``, ``49.62``."""
    return F.regexp_replace(col.cast("decimal(38,2)").cast("string"), r"(\.\d)0$", "$1")
