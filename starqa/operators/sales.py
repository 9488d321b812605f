"""The line-level sales view and the aggregates the questions start from.

Each aggregate sums on surrogate keys before it looks names up, so that the
joins with dimensions move one row per key instead of one per line, and a key
that owns a large share of the lines is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starqa.operators.joins import join_many_to_one
from starqa.sources.storage import stored
from starqa.sources.warehouse import Star


def sales_view(star: Star, strict: bool = False) -> DataFrame:
    """One row per line with every dimension attached; misses stay null."""
    # Headers meet their customers first: that join moves headers, not lines.
    headers = join_many_to_one(star.invoices(), star.customer, "customer_id", strict)
    sales = join_many_to_one(star.line, headers, "invoice_id", strict)
    attributes = ["track_name", "album_title", "genre_name"]
    if "artist_id" not in star.line.columns:
        attributes.append("artist_name")
    sales = join_many_to_one(sales, star.tracks(*attributes, strict=strict), "track_id", strict)
    if "artist_id" in star.line.columns:
        sales = join_many_to_one(sales, star.artist, "artist_id", strict)
    return sales.select(
        "invoice_id", "customer_id", "customer_name", "country", "invoice_date", "year",
        "quarter", "track_id", "track_name", "album_title", "artist_name", "genre_name",
        "unit_price", "quantity", "revenue",
    )


def invoice_revenue(star: Star, year: int | None = None) -> DataFrame:
    """Line revenue per invoice, with the invoice's customer and year."""
    per_invoice = star.line.groupBy("invoice_id").agg(F.sum("revenue").alias("revenue"))
    return per_invoice.join(
        star.invoices(year).select("invoice_id", "customer_id", "year"), "invoice_id"
    )


def _of_year(df: DataFrame, year: int | None) -> DataFrame:
    return df if year is None else df.filter(F.col("year") == year)


def customer_year_revenue(star: Star, year: int | None = None) -> DataFrame:
    """Revenue per customer and year, exact (not yet rounded)."""
    if "customer_year" in star.stored:
        return _of_year(star.stored["customer_year"], year)
    return (
        invoice_revenue(star, year)
        .groupBy("customer_id", "year")
        .agg(F.sum("revenue").alias("revenue"))
    )


def dated_revenue(star: Star, year: int | None = None) -> DataFrame:
    """Revenue with its year, at the coarsest grain at hand."""
    if "customer_year" in star.stored:
        return customer_year_revenue(star, year)
    return invoice_revenue(star, year)


def customer_year_orders(star: Star, year: int | None = None) -> DataFrame:
    """Number of invoices per customer and year; reads no lines."""
    return (
        star.invoices(year)
        .groupBy("customer_id", "year")
        .agg(F.count("*").alias("orders"))
    )


def _dated_lines(star: Star, year: int | None, *columns: str) -> DataFrame:
    return star.line.select("invoice_id", *columns).join(
        star.invoices(year).select("invoice_id", "year"), "invoice_id"
    )


def track_year_sales(star: Star, year: int | None = None) -> DataFrame:
    """Quantity and revenue per track and year."""
    if "track_year" in star.stored:
        return _of_year(star.stored["track_year"], year)
    return (
        _dated_lines(star, year, "track_id", "quantity", "revenue")
        .groupBy("track_id", "year")
        .agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    )


def artist_year_revenue(star: Star, year: int | None = None) -> DataFrame:
    """Revenue per artist name and year; lines without an artist drop out."""
    if "artist_year" in star.stored:
        return _of_year(star.stored["artist_year"], year)
    if "artist_id" in star.line.columns:
        per_key = (
            _dated_lines(star, year, "artist_id", "revenue")
            .groupBy("artist_id", "year")
            .agg(F.sum("revenue").alias("revenue"))
            .join(star.artist, "artist_id")
        )
    else:
        per_key = (
            track_year_sales(star, year)
            .join(star.tracks("artist_name"), "track_id")
        )
    return _by_artist(per_key)


def _by_artist(per_key: DataFrame) -> DataFrame:
    return (
        per_key.filter(F.col("artist_name").isNotNull())
        .groupBy("artist_name", "year")
        .agg(F.sum("revenue").alias("revenue"))
    )


def country_genre_revenue(star: Star, country: str | None = None) -> DataFrame:
    """Revenue per customer country and genre, over all years."""
    if "country_genre" in star.stored:
        known = star.stored["country_genre"]
        return known if country is None else known.filter(F.col("country") == country)
    customers = star.customer.select("customer_id", "country").filter(
        F.col("country").isNotNull()
    )
    if country is not None:
        customers = customers.filter(F.col("country") == country)
    headers = star.invoice.select("invoice_id", "customer_id").join(customers, "customer_id")
    per_track = (
        star.line.select("invoice_id", "track_id", "revenue")
        .join(headers.select("invoice_id", "country"), "invoice_id")
        .groupBy("country", "track_id")
        .agg(F.sum("revenue").alias("revenue"))
    )
    return _by_country_genre(star, per_track)


def _by_country_genre(star: Star, per_track: DataFrame) -> DataFrame:
    return (
        per_track.join(star.tracks("genre_name"), "track_id")
        .filter(F.col("genre_name").isNotNull())
        .groupBy("country", "genre_name")
        .agg(F.sum("revenue").alias("revenue"))
    )


#: What each stored aggregate is summed by.
SETS = {
    "customer_year": ("customer_id", "year"),
    "track_year": ("track_id", "year"),
    "artist_year": ("artist_id", "year"),
    "country_genre": ("country", "track_id"),
}


def with_stored_aggregates(star: Star, names: Collection[str] = tuple(SETS)) -> Star:
    """The star with the named aggregates written down once.

    For several questions over one star: lines meet their headers once, are
    summed by all the keys in one aggregation, and each question then starts
    from its part of the table of sums.
    """
    wanted = [n for n in SETS if n in names and n not in star.stored]
    if not wanted:
        return star
    keyed = "artist_id" in star.line.columns
    sets = {n: SETS[n] for n in dict.fromkeys(n if keyed or n != "artist_year" else "track_year" for n in wanted)}
    headers = star.invoices().select("invoice_id", "customer_id", "year")
    if "country_genre" in sets:
        headers = headers.join(star.customer.select("customer_id", "country"), "customer_id", "left")
    keys = list(dict.fromkeys(key for by in sets.values() for key in by))
    in_line = [k for k in ("track_id", "artist_id") if k in keys]
    lines = star.line.select("invoice_id", *in_line, "quantity", "revenue").join(headers, "invoice_id")
    # The key that only one of the sets has tells them apart.
    sign = {"customer_year": "customer_id", "artist_year": "artist_id", "country_genre": "country"}
    name = F.lit("track_year")
    for n in sets:
        if n in sign:
            name = F.when(F.grouping(sign[n]) == 0, n).otherwise(name)
    sums = lines.groupingSets([list(by) for by in sets.values()], *keys).agg(
        F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), name.alias("aggregate")
    )
    table = stored(sums, "sums", partition_by="aggregate", reuse=star.reuse)
    part = lambda n: table.filter(F.col("aggregate") == n)
    ready = {}
    if "customer_year" in sets:
        ready["customer_year"] = part("customer_year").select("customer_id", "year", "revenue")
    if "track_year" in sets:
        ready["track_year"] = part("track_year").select("track_id", "year", "quantity", "revenue")
    star = replace(star, stored={**star.stored, **ready})
    if "artist_year" in wanted:
        if keyed:
            per_key = part("artist_year").join(star.artist, "artist_id")
            by_artist = _by_artist(per_key)
        else:
            by_artist = artist_year_revenue(star)
        star = replace(star, stored={**star.stored, "artist_year": by_artist})
    if "country_genre" in wanted:
        per_track = part("country_genre").filter(F.col("country").isNotNull())
        star = replace(star, stored={**star.stored, "country_genre": _by_country_genre(star, per_track)})
    return star
