"""The nine questions over a tiny store whose answers are worked out by hand."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from starqa.functions.money import cents_text, round_cents
from starqa.operators.sales import sales_view, with_stored_aggregates
from starqa.plans import questions
from starqa.sources.warehouse import star_of_music



def bands(df, *params):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[p] for p in params), set()).add((r.display, r.lo, r.hi))
    return out


def test_sales_view(music):
    rows = {r.invoice_id: r for r in sales_view(music).collect()}
    assert sales_view(music).count() == 8
    assert rows[4].artist_name == "AC/DC" and rows[4].album_title == "High"
    assert (rows[4].year, rows[4].quarter, rows[4].revenue) == (2023, 1, Decimal("3.96"))
    assert rows[6].customer_name == "Di"
    assert rows[5].country is None


def test_strict_view_refuses_repeated_keys(spark, music_tables):
    twice = {**music_tables, "Genre": music_tables["Genre"].union(music_tables["Genre"])}
    assert sales_view(star_of_music(music_tables), strict=True).count() == 8
    with pytest.raises(Exception, match="genre_id repeats: "):
        sales_view(star_of_music(twice), strict=True).collect()


def test_customer_count(music):
    rows = {r.country: r.value for r in questions.customer_count_in_country(music).collect()}
    assert rows == {"Brazil": 2, "Norway": 2}
    assert questions.customer_count_in_country(music, "Norway").first().value == 2


def test_total_revenue(music):
    rows = {r.year: r.value for r in questions.total_revenue_in_year(music).collect()}
    assert rows == {2021: Decimal("7.94"), 2023: Decimal("5.95")}
    assert [r.value for r in questions.total_revenue_in_year(music, 2023).collect()] == [Decimal("5.95")]
    assert questions.total_revenue_in_year(music, 2022).count() == 0


def test_tracks_sold(music):
    rows = {(r.genre, r.year): r.value for r in questions.tracks_sold_in_genre_year(music).collect()}
    assert rows == {("Rock", 2021): 3, ("Rock", 2023): 4, ("Latin", 2021): 3, ("Latin", 2023): 1}


def test_top_customers(music):
    found = bands(questions.top_customers(music, ks=[1, 2, 3, 5]), "year", "k")
    tied = {("Ana Silva", 0, 1), ("Bo Silva", 0, 1)}
    assert found[2021, 1] == tied and found[2021, 2] == tied
    assert found[2021, 3] == tied | {("Cy Lund", 2, 3), ("Di", 2, 3)}
    assert found[2023, 2] == {("Cy Lund", 0, 0), ("Ed Nomad", 1, 1)}
    assert (2023, 3) not in found and (2021, 5) not in found


def test_top_customers_by_orders(music):
    found = bands(questions.top_customers(music, ks=[1], measure="orders", year=2021), "k")
    assert len(found[1,]) == 4 and all(b[1:] == (0, 3) for b in found[1,])


def test_top_artists(music):
    found = bands(questions.top_artists(music, ks=[2]), "year")
    assert found[2021,] == {("AC/DC", 1, 1), ("Antônio Jobim", 0, 0)} or found[2021,] == {
        ("AC/DC", 0, 0), ("Antônio Jobim", 1, 1)
    }
    # AC/DC: three tracks and one other at 0.99; Jobim: two at 1.99
    values = {r.display: r.value for r in questions.top_artists(music, ks=[2], year=2021).collect()}
    assert values == {"AC/DC": Decimal("3.96"), "Antônio Jobim": Decimal("3.98")}


def test_top_genre(music):
    found = bands(questions.top_genre_in_country(music), "country")
    assert found == {("Brazil",): {("Latin", 0, 0)}, ("Norway",): {("Rock", 0, 0)}}
    assert {r.genre_name for r in questions.losing_genres(music).filter("country = 'Brazil'").collect()} == {"Rock", "Jazz"}


def test_eligible_countries_fall_back_to_all(spark, music_tables):
    few = {**music_tables, "Customer": music_tables["Customer"].filter("CustomerId in (1, 3)")}
    assert {r.country for r in questions.eligible_countries(star_of_music(few)).collect()} == {"Brazil", "Norway"}
    uneven = {**music_tables, "Customer": music_tables["Customer"].filter("CustomerId <> 4")}
    assert {r.country for r in questions.eligible_countries(star_of_music(uneven)).collect()} == {"Brazil"}


def test_top_countries(music):
    found = bands(questions.top_countries(music, ks=[1, 2]), "year", "k")
    assert found[2021, 2] == {("Brazil", 0, 0), ("Norway", 1, 1)}
    assert found[2023, 1] == {("Norway", 0, 0)} and (2023, 2) not in found


def test_revenue_increase_counts_absence_as_zero(music):
    rows = questions.revenue_increase(music, ks=[3, 5]).collect()
    values = {r.display: (r.lo, r.hi, r.value) for r in rows if r.k == 5}
    assert values == {
        "Cy Lund": (0, 0, Decimal("2.97")),
        "Ed Nomad": (1, 1, Decimal("1.99")),
        "Di": (2, 2, Decimal("-0.99")),
        "Ana Silva": (3, 4, Decimal("-2.98")),
        "Bo Silva": (3, 4, Decimal("-2.98")),
    }
    narrowed = questions.revenue_increase(music, ks=[1], year_a=2021, year_b=2023).collect()
    assert [r.display for r in narrowed] == ["Cy Lund"]


def test_revenue_increase_needs_a_gain(spark, music_tables):
    lost = {**music_tables, "Invoice": music_tables["Invoice"].filter("InvoiceId in (1, 2, 3, 6) or InvoiceId = 99")}
    late = lost["Invoice"].filter("InvoiceId = 1").withColumn("InvoiceId", F.lit(99)).withColumn(
        "InvoiceDate", F.expr("InvoiceDate + interval 2 years")
    )
    cheap = music_tables["InvoiceLine"].filter("InvoiceLineId = 1").withColumn("InvoiceId", F.lit(99))
    tables = {
        **lost,
        "Invoice": lost["Invoice"].union(late),
        "InvoiceLine": music_tables["InvoiceLine"].union(cheap),
    }
    # the only sale of the later year is less than its customer spent before
    assert questions.revenue_increase(star_of_music(tables), ks=[1]).count() == 0


def test_no_sales(music):
    rows = {(r.genre, r.year, r.member, r.n_silent) for r in questions.no_sales_in_year(music).collect()}
    assert rows == {
        ("Rock", 2021, "Quiet One", 1),
        ("Rock", 2023, "Quiet One", 1),
        ("Latin", 2023, "AC/DC", 1),
    }
    one = questions.no_sales_in_year(music, genre="Rock", year=2022).collect()
    assert {r.member for r in one} == {"AC/DC", "Quiet One"}


def test_stored_aggregates_change_nothing(music):
    stored = with_stored_aggregates(music)
    for ask in (questions.total_revenue_in_year, questions.tracks_sold_in_genre_year, questions.top_artists,
                questions.top_countries, questions.top_genre_in_country, questions.no_sales_in_year):
        assert sorted(map(str, ask(stored).collect())) == sorted(map(str, ask(music).collect()))
    assert questions.total_revenue_in_year(stored, 2021).first().value == Decimal("7.94")


@pytest.mark.parametrize("value,cents", [("0.125", "0.13"), ("2.675", "2.68"), ("1.005", "1.01"), ("-0.125", "-0.13")])
def test_cents_round_half_up(spark, value, cents):
    row = spark.range(1).select(round_cents(F.lit(Decimal(value)))).first()
    assert row[0] == Decimal(cents)


def test_cents_text(spark):
    texts = spark.createDataFrame([(5.0,), (2328.6,), (49.62,), (12345678.0,)], "v double")
    assert [r[0] for r in texts.select(cents_text(F.col("v"))).collect()] == ["5.0", "2328.6", "49.62", "12345678.0"]


def test_prices_below_a_cent_are_rounded_once(spark, music_tables):
    for price, quantity, wanted in ((0.004, 1000, "4.00"), (0.995, 3, "2.99")):
        lines = music_tables["InvoiceLine"].limit(1).withColumn("UnitPrice", F.lit(price)).withColumn("Quantity", F.lit(quantity))
        star = star_of_music(music_tables | {"InvoiceLine": lines})
        assert [str(r.value) for r in questions.total_revenue_in_year(star).collect()] == [wanted]


def test_member_years_over_a_long_calendar(spark, music, music_tables):
    """Bitmaps of several words: a member sold in 150 different years, others never."""
    from datetime import datetime

    from starqa.sources.warehouse import star_of_music

    years = list(range(1870, 2020))
    invoices = [(i, 1, datetime(y, 5, 1), "Norway", 1.0) for i, y in enumerate(years)]
    lines = [(i, i, 1, 1.0, 1) for i in range(len(years)) if years[i] % 3]
    tables = music_tables | {
        "Invoice": spark.createDataFrame(invoices, music_tables["Invoice"].schema),
        "InvoiceLine": spark.createDataFrame(lines, music_tables["InvoiceLine"].schema),
    }
    star = star_of_music(tables)
    member = music_tables["Track"].filter("TrackId = 1").first()
    bits = questions.member_years(star, years)
    assert bits.columns == ["genre", "member", "sold_0", "sold_1", "sold_2"]
    sold = {}
    for r in bits.collect():
        sold[r.genre, r.member] = [y for i, y in enumerate(years) if r[f"sold_{i // 62}"] >> i % 62 & 1]
    assert sorted(sold.values())[-1] == [y for y in years if y % 3] and sum(map(bool, sold.values())) == 1
    assert member is not None and bits.count() == questions.catalogue(star).count()
