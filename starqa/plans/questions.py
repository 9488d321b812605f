"""The nine questions, each answered for every parameter value in one job.

A keyword argument narrows a question to one value; the filter then reaches
the scan.  Ranked answers have one row per entity and ``k``:
``lo``/``hi`` is the band of zero-based positions the entity may take,
``key``, ``display`` and ``last_name`` identify it, ``order_key`` orders
entities of one band.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starqa import fixed_values as fixed
from starqa.functions.money import round_cents, total
from starqa.functions.names import order_text
from starqa.operators.ranking import cell_bounds, for_each_k, top_k_with_ties, winners
from starqa.operators.sales import (
    artist_year_revenue,
    country_genre_revenue,
    customer_year_orders,
    customer_year_revenue,
    dated_revenue,
    track_year_sales,
)
from starqa.sources.storage import stored
from starqa.sources.warehouse import Star


def year_row(df: DataFrame) -> DataFrame:
    """One row holding the sorted years of a frame; bounded by the calendar."""
    return (
        df.filter(F.col("year").isNotNull())
        .select("year")
        .distinct()
        .agg(F.array_sort(F.collect_list("year")).alias("years"))
    )


def year_array(df: DataFrame, years: Sequence[int] | None = None) -> Column:
    """The sorted years of a frame as an array; ``years`` if they are known."""
    if years is not None:
        return F.array(*[F.lit(y) for y in years])
    return year_row(df).scalar()


def year_pairs(df: DataFrame, years: Sequence[int] | None = None) -> Column:
    """All pairs of an earlier and a later year of a frame as an array."""
    if years is not None:
        return F.array(
            *[
                F.struct(F.lit(a).alias("year_a"), F.lit(b).alias("year_b"))
                for a in years
                for b in years
                if a < b
            ]
        )
    pairs = F.flatten(
        F.transform(
            "years",
            lambda a: F.transform(
                F.filter("years", lambda b: b > a),
                lambda b: F.struct(a.alias("year_a"), b.alias("year_b")),
            ),
        )
    )
    return year_row(df).select(pairs).scalar()


def customer_count_in_country(star: Star, country: str | None = None) -> DataFrame:
    """Customers per country: ``country, value``."""
    counts = customers_per_country(star).withColumnRenamed("customers", "value")
    return counts if country is None else counts.filter(F.col("country") == country)


def total_revenue_in_year(star: Star, year: int | None = None) -> DataFrame:
    """Revenue per year: ``year, value``."""
    return (
        dated_revenue(star, year)
        .filter(F.col("year").isNotNull())
        .groupBy("year")
        .agg(round_cents(total(F.col("revenue"))).alias("value"))
    )


def tracks_sold_in_genre_year(
    star: Star, genre: str | None = None, year: int | None = None
) -> DataFrame:
    """Quantity per genre and year, where there is any: ``genre, year, value``."""
    tracks = star.tracks("genre_name").filter(F.col("genre_name").isNotNull())
    if genre is not None:
        tracks = tracks.filter(F.col("genre_name") == genre)
    return (
        track_year_sales(star, year)
        .join(tracks, "track_id")
        .filter(F.col("year").isNotNull())
        .groupBy(F.col("genre_name").alias("genre"), "year")
        .agg(total(F.col("quantity")).cast("bigint").alias("value"))
        .filter("value <> 0")
    )


RANKED = ("k", "tie_group", "lo", "hi", "key", "display", "last_name", "order_key", "value")


def _named_customers(ranked: DataFrame, star: Star, params: Sequence[str]) -> DataFrame:
    customers = star.customer.select("customer_id", "customer_name", "last_name")
    return (
        ranked.join(customers, "customer_id", "left")
        .withColumn("key", F.col("customer_id").cast("string"))
        .withColumn("display", F.col("customer_name"))
        .withColumn("order_key", order_text(F.col("customer_id")))
        .select(*params, *RANKED)
    )


def _named_plainly(ranked: DataFrame, name: str, params: Sequence[str]) -> DataFrame:
    return (
        ranked.withColumn("key", F.col(name))
        .withColumn("display", F.col(name))
        .withColumn("last_name", F.lit(None).cast("string"))
        .withColumn("order_key", F.col(name))
        .select(*params, *RANKED)
    )


def top_customers(
    star: Star,
    ks: Sequence[int] = fixed.TOP_KS,
    year: int | None = None,
    measure: str = "revenue",
) -> DataFrame:
    """First ``k`` customers of each year by revenue, or by number of orders."""
    if measure == "orders":
        per_year = customer_year_orders(star, year).withColumn("value", F.col("orders"))
    else:
        per_year = customer_year_revenue(star, year).withColumn(
            "value", round_cents(F.col("revenue"))
        )
    known = per_year.filter("customer_id is not null and year is not null")
    top = top_k_with_ties(
        known.select("customer_id", "year", "value"), ["year"], "value", "customer_id", max(ks)
    )
    return _named_customers(for_each_k(top, ks), star, ["year"])


def top_artists(
    star: Star, ks: Sequence[int] = fixed.TOP_KS, year: int | None = None
) -> DataFrame:
    """First ``k`` artists of each year by revenue."""
    per_year = artist_year_revenue(star, year).filter("year is not null")
    valued = per_year.select("artist_name", "year", round_cents(F.col("revenue")).alias("value"))
    top = top_k_with_ties(valued, ["year"], "value", "artist_name", max(ks))
    return _named_plainly(for_each_k(top, ks), "artist_name", ["year"])


def country_year_revenue(star: Star, year: int | None = None) -> DataFrame:
    """Revenue per customer country and year."""
    return (
        customer_year_revenue(star, year)
        .join(star.customer.select("customer_id", "country"), "customer_id")
        .filter("country is not null and year is not null")
        .groupBy("country", "year")
        .agg(F.sum("revenue").alias("revenue"))
    )


def top_countries(
    star: Star, ks: Sequence[int] = fixed.TOP_KS, year: int | None = None
) -> DataFrame:
    """First ``k`` customer countries of each year by revenue."""
    valued = country_year_revenue(star, year).select(
        "country", "year", round_cents(F.col("revenue")).alias("value")
    )
    top = top_k_with_ties(valued, ["year"], "value", "country", max(ks))
    return _named_plainly(for_each_k(top, ks), "country", ["year"])


def customers_per_country(star: Star) -> DataFrame:
    """Number of customers of each country: ``country, customers``."""
    known = star.customer.filter(F.col("country").isNotNull())
    return known.groupBy("country").agg(F.count("*").alias("customers"))


def eligible_countries(star: Star) -> DataFrame:
    """Countries with at least two customers; all of them when none has two."""
    counts = customers_per_country(star)
    most = counts.agg(F.max("customers")).scalar()
    needed = F.least(F.lit(fixed.MIN_CUSTOMERS_PER_COUNTRY), most)
    return counts.filter(F.col("customers") >= needed)


def top_genre_in_country(star: Star, country: str | None = None) -> DataFrame:
    """Genre with the most revenue per eligible country; all that tie."""
    eligible = eligible_countries(star).select("country")
    valued = (
        country_genre_revenue(star, country)
        .join(eligible, "country", "left_semi")
        .select("country", "genre_name", round_cents(F.col("revenue")).alias("value"))
    )
    best = winners(valued, ["country"], "value", "genre_name")
    return _named_plainly(best.withColumn("k", F.lit(1)), "genre_name", ["country"])


def genre_universe(star: Star) -> DataFrame:
    """Every genre name: the candidates an answer may mention."""
    return star.genre.select("genre_name").filter("genre_name is not null").distinct()


def losing_genres(star: Star, country: str | None = None) -> DataFrame:
    """Candidates that are not a winner of their country: ``country, genre_name``, all countries in one job.

    Every country that has winners is paired with the names of the genre
    dimension, held as one array.
    """
    best = top_genre_in_country(star, country).select("country", F.col("key").alias("genre_name"))
    names = genre_universe(star).agg(F.array_sort(F.collect_list("genre_name"))).scalar()
    candidates = best.select("country").distinct().withColumn("genre_name", F.explode(names))
    return candidates.join(best, ["country", "genre_name"], "left_anti")


def revenue_increase(
    star: Star,
    ks: Sequence[int] = fixed.TOP_KS,
    year_a: int | None = None,
    year_b: int | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """First ``k`` customers by revenue change for each pair of years.

    A customer without sales in a year counts as 0.00 for it, so every customer
    takes part in every pair.  Pairs in which nobody gained are left out.
    """
    per_year = customer_year_revenue(star).filter("year is not null")
    if year_a is not None and year_b is not None:
        per_year = per_year.filter(F.col("year").isin(year_a, year_b))
        years = [year_a, year_b]
    # One row per customer: at most one map entry per calendar year.  Written once,
    # since the years, the bounds and the rankings all read it.
    by_customer = stored(
        per_year.groupBy("customer_id").agg(
            F.map_from_entries(
                F.collect_list(F.struct("year", round_cents(F.col("revenue"))))
            ).alias("by_year")
        ),
        "customer-years",
        reuse=star.reuse,
    )
    active = by_customer.select(F.explode(F.map_keys("by_year")).alias("year"))
    zero = F.lit(0).cast("decimal(38,2)")
    customers = star.customer.select("customer_id").filter("customer_id is not null").join(by_customer, "customer_id", "left")
    in_year = lambda y: F.coalesce(F.try_element_at("by_year", y), zero)
    change = lambda p: round_cents(in_year(p["year_b"]) - in_year(p["year_a"]))
    pair = ["year_a", "year_b"]
    of_pair = lambda p, *more: F.struct(*[p[y].alias(y) for y in pair], change(p).alias("value"), *[p[m].alias(m) for m in more])
    every = customers.withColumn("_pairs", year_pairs(active, years)).select(
        "customer_id", F.inline(F.transform("_pairs", lambda p: of_pair(p)))
    )
    # As many bounds as the calendar has pairs of years; rows below them go before they are sent anywhere.
    bounds = cell_bounds(every, pair, "value", "customer_id", max(ks))
    bounded = bounds.agg(F.collect_list(F.struct(*pair, "bound"))).scalar()
    possible = lambda c: c["bound"].isNull() | (c["value"] >= c["bound"])
    near = customers.withColumn("_pairs", bounded).select(
        "customer_id", F.inline(F.filter(F.transform("_pairs", lambda p: of_pair(p, "bound")), possible))
    ).drop("bound")
    top = top_k_with_ties(near, pair, "value", "customer_id", max(ks))
    return _named_customers(
        for_each_k(top, ks, F.col("best") > 0), star, ["year_a", "year_b"]
    )


def catalogue(star: Star) -> DataFrame:
    """Members with a track in a genre, sold or not: ``genre, member``."""
    return (
        star.tracks("genre_name", star.member)
        .select(F.col("genre_name").alias("genre"), F.col(star.member).alias("member"))
        .dropna()
        .distinct()
    )


#: Years whose bits one whole number holds.
YEARS_A_WORD = 62


def member_years(star: Star, years: Sequence[int], year: int | None = None) -> DataFrame:
    """``genre, member`` and the years with a sale as bitmaps, one row per catalogue member, sold or not.

    ``sold_0``, ``sold_1``, ... hold the bits of 62 years each, in the order of
    ``years``.  Bits of a track, then of a member, are joined by ``bit_or``, which
    each task does before it sends them: a member moves as one row, however many
    years and tracks it has.
    """
    words = [list(years[a : a + YEARS_A_WORD]) for a in range(0, len(years), YEARS_A_WORD)]

    def bits(of: list[int]) -> Column:
        place = F.array_position(F.array(*[F.lit(y) for y in of]), F.col("year"))
        return F.coalesce(F.bit_or(F.when(place > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (place - 1).cast("int")))), F.lit(0).cast("bigint"))

    by_track = track_year_sales(star, year).groupBy("track_id").agg(*[bits(w).alias(f"_bits_{i}") for i, w in enumerate(words)])
    members = star.tracks("genre_name", star.member).select(
        "track_id", F.col("genre_name").alias("genre"), F.col(star.member).alias("member")
    )
    known = members.filter("genre is not null and member is not null and track_id is not null")
    return known.join(by_track, "track_id", "left").groupBy("genre", "member").agg(
        *[F.coalesce(F.bit_or(f"_bits_{i}"), F.lit(0).cast("bigint")).alias(f"sold_{i}") for i in range(len(words))]
    )


def no_sales_in_year(
    star: Star,
    genre: str | None = None,
    year: int | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Catalogue members of a genre without a sale of that genre in a year.

    Only sets of 1 to 15 members count.  Sizes are compared first, so that the
    catalogue is expanded by year for the few sets that qualify and not for all.
    One aggregate of the lines serves everything: it has the years, and one
    bitmap of years per member says where it was sold and where not.
    """
    if year is not None:
        years = [year]
    elif "track_year" not in star.stored:
        star = replace(star, stored={**star.stored, "track_year": stored(track_year_sales(star), "track-years", reuse=star.reuse)})
    if years is None:
        # As many numbers as the calendar has years.
        found = star.stored["track_year"].select("year").distinct().filter("year is not null")
        years = sorted(r.year for r in found.collect())
    years = list(years)
    members = member_years(star, years, year)
    if genre is not None:
        members = members.filter(F.col("genre") == genre)
    members = stored(members, "member-years", reuse=star.reuse)
    sold = lambda i: F.col(f"sold_{i // YEARS_A_WORD}").bitwiseAND(F.lit(1 << (i % YEARS_A_WORD))) != 0
    silent = [F.struct(F.lit(i).alias("place"), F.lit(y).alias("year"), F.count_if(~sold(i)).alias("n_silent")) for i, y in enumerate(years)]
    if not years:
        return members.select("genre", F.lit(None).cast("int").alias("year"), "member", F.lit(None).cast("bigint").alias("n_silent")).limit(0)
    sizes = (
        members.groupBy("genre")
        .agg(F.count("*").alias("n_members"), F.array(*silent).alias("sets"))
        .filter(F.col("n_members") >= fixed.MIN_CATALOGUE)
        .select("genre", F.filter("sets", lambda s: s["n_silent"].between(fixed.MIN_SET_ANSWERS, fixed.MAX_SET_ANSWERS)).alias("sets"))
        .filter(F.size("sets") > 0)
    )
    flags = F.array(*[sold(i) for i in range(len(years))])
    return (
        members.select("genre", "member", flags.alias("sold"))
        .join(sizes, "genre")
        .select("genre", "member", F.explode(F.filter("sets", lambda s: ~F.get("sold", s["place"]))).alias("s"))
        .select("genre", "s.year", "member", "s.n_silent")
    )
