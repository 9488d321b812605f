"""Reading a warehouse layout into the star the questions are asked of."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starqa.functions.money import as_money
from starqa.functions.names import full_name
from starqa.operators.joins import join_many_to_one
from starqa.sources.schemas import MUSIC_STORE, ORDERS, TableSpec


def read_tables(
    spark: SparkSession, folder: str, layout: dict[str, TableSpec]
) -> dict[str, DataFrame]:
    """Every table of a layout, with its declared schema."""
    return {
        name: spark.read.schema(spec.struct()).parquet(f"{folder}/{name}.parquet")
        for name, spec in layout.items()
    }


def read_tables_cast(
    spark: SparkSession, folder: str, layout: dict[str, TableSpec]
) -> dict[str, DataFrame]:
    """Every table of a layout as stored, its columns cast to the declared types.

    For exports whose integer widths or date types differ from the declared ones.
    """
    return {
        name: spark.read.parquet(f"{folder}/{name}.parquet").select(
            *[F.col(f.name).cast(f.dataType) for f in spec.struct()]
        )
        for name, spec in layout.items()
    }


@dataclass(frozen=True)
class Star:
    """Fact, header and dimension frames under common column names.

    ``customer``  customer_id, customer_name, last_name, country
    ``invoice``   invoice_id, customer_id, invoice_date, total
    ``line``      invoice_id, track_id, unit_price, quantity, revenue
                  [artist_id, when the line itself names the artist]
    ``track``     track_id, track_name, and album_id / genre_id or the resolved
                  album_title / artist_name / genre_name
    ``album``, ``artist``, ``genre``   the snowflaked dimensions, where present
    ``stored``    aggregates already written down, by name (see
                  :func:`starqa.operators.sales.with_stored_aggregates`)
    ``reuse``     whether tables written on the way may be those that this session
                  has written before from the same files
    ``member``    column of ``track`` that names the catalogue member (the
                  "artist" of the no-sales question)
    """

    customer: DataFrame
    invoice: DataFrame
    line: DataFrame
    track: DataFrame
    artist: DataFrame
    genre: DataFrame
    album: DataFrame | None = None
    member: str = "artist_name"
    stored: dict[str, DataFrame] = field(default_factory=dict)
    reuse: bool = False

    def tracks(self, *wanted: str, strict: bool = False) -> DataFrame:
        """Tracks with the wanted attributes, joining only what they need."""
        tracks = self.track
        missing = set(wanted) - set(tracks.columns)
        if missing & {"album_title", "artist_id", "artist_name"}:
            tracks = join_many_to_one(tracks, self.album, "album_id", strict)
        if "artist_name" in missing:
            tracks = join_many_to_one(tracks, self.artist, "artist_id", strict)
        if "genre_name" in missing:
            tracks = join_many_to_one(tracks, self.genre, "genre_id", strict)
        return tracks.select("track_id", *wanted)

    def invoices(self, year: int | None = None) -> DataFrame:
        """Invoice headers with year and quarter.

        One year is asked for as a date range, which reaches the parquet scan;
        ``year(date) = y`` would not.
        """
        headers = self.invoice
        if year is not None:
            start, end = f"{year:04d}-01-01", f"{year + 1:04d}-01-01"
            date = F.col("invoice_date")
            headers = headers.filter(
                (date >= F.lit(start).cast("timestamp_ntz"))
                & (date < F.lit(end).cast("timestamp_ntz"))
            )
        return headers.withColumn("year", F.year("invoice_date")).withColumn(
            "quarter", F.quarter("invoice_date")
        )


def music_store(spark: SparkSession, folder: str) -> Star:
    """The music-store layout: invoices of tracks, by album, artist and genre."""
    return star_of_music(read_tables_cast(spark, folder, MUSIC_STORE))


def star_of_music(tables: dict[str, DataFrame]) -> Star:
    line = tables["InvoiceLine"].select(
        F.col("InvoiceId").alias("invoice_id"),
        F.col("TrackId").alias("track_id"),
        as_money(F.col("UnitPrice")).alias("unit_price"),
        F.col("Quantity").alias("quantity"),
    )
    return Star(
        customer=tables["Customer"].select(
            F.col("CustomerId").alias("customer_id"),
            full_name(F.col("FirstName"), F.col("LastName")).alias("customer_name"),
            F.col("LastName").alias("last_name"),
            F.col("Country").alias("country"),
        ),
        invoice=tables["Invoice"].select(
            F.col("InvoiceId").alias("invoice_id"),
            F.col("CustomerId").alias("customer_id"),
            F.col("InvoiceDate").alias("invoice_date"),
            as_money(F.col("Total")).alias("total"),
        ),
        line=line.withColumn(
            "revenue", F.col("unit_price") * F.col("quantity").cast("decimal(10,0)")
        ),
        track=tables["Track"].select(
            F.col("TrackId").alias("track_id"),
            F.col("Name").alias("track_name"),
            F.col("AlbumId").alias("album_id"),
            F.col("GenreId").alias("genre_id"),
        ),
        album=tables["Album"].select(
            F.col("AlbumId").alias("album_id"),
            F.col("Title").alias("album_title"),
            F.col("ArtistId").alias("artist_id"),
        ),
        artist=tables["Artist"].select(
            F.col("ArtistId").alias("artist_id"), F.col("Name").alias("artist_name")
        ),
        genre=tables["Genre"].select(
            F.col("GenreId").alias("genre_id"), F.col("Name").alias("genre_name")
        ),
    )


def orders_store(spark: SparkSession, folder: str, last_name: str | None = None) -> Star:
    """The order-processing layout, mapped to the star.

    Orders are invoices, parts are tracks, brands genres and part types albums.
    The artist of a line is its supplier; the catalogue member is the part
    itself.  ``last_name`` may name a customer column to use as extra alias.
    """
    tables = read_tables(spark, folder, ORDERS)
    price = as_money(F.col("l_extendedprice"))
    kept = (F.lit(1) - as_money(F.col("l_discount"))).cast("decimal(8,6)")
    countries = tables["nation"].select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country")
    )
    return Star(
        customer=tables["customer"]
        .join(countries, "c_nationkey", "left")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            (F.col(last_name) if last_name else F.lit(None).cast("string")).alias("last_name"),
            "country",
        ),
        invoice=tables["orders"].select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("invoice_date"),
            as_money(F.col("o_totalprice")).alias("total"),
        ),
        line=tables["lineitem"].select(
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_partkey").alias("track_id"),
            F.col("l_suppkey").alias("artist_id"),
            price.alias("unit_price"),
            as_money(F.col("l_quantity")).alias("quantity"),
            (price * kept).alias("revenue"),
        ),
        track=tables["part"].select(
            F.col("p_partkey").alias("track_id"),
            F.col("p_name").alias("track_name"),
            F.col("p_type").alias("album_title"),
            F.col("p_brand").alias("genre_name"),
            F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("member_name"),
        ),
        artist=tables["supplier"].select(
            F.col("s_suppkey").alias("artist_id"), F.col("s_name").alias("artist_name")
        ),
        genre=tables["part"].select(F.col("p_brand").alias("genre_name")).distinct(),
        member="member_name",
    )
