import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("starqa-tests")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def music_tables(spark):
    """A tiny music store: ties, an unsold artist, a gap year, a customer without sales."""
    from datetime import datetime

    frame = spark.createDataFrame
    day = lambda text: datetime.fromisoformat(text)
    return {
        "Artist": frame([(1, "AC/DC"), (2, "Antônio Jobim"), (3, "Quiet One")], "ArtistId int, Name string"),
        "Album": frame(
            [(1, "High", 1), (2, "Wave", 2), (3, "Hush", 3)], "AlbumId int, Title string, ArtistId int"
        ),
        "Genre": frame([(1, "Rock"), (2, "Latin"), (3, "Jazz")], "GenreId int, Name string"),
        "Track": frame(
            [(1, "A", 1, 1), (2, "B", 2, 2), (3, "C", 3, 1), (4, "D", 1, 2)],
            "TrackId int, Name string, AlbumId int, GenreId int",
        ),
        "Customer": frame(
            [
                (1, "Ana", "Silva", "Brazil"),
                (2, "Bo", "Silva", "Brazil"),
                (3, "Cy", "Lund", "Norway"),
                (4, "Di", None, "Norway"),
                (5, "Ed", "Nomad", None),
            ],
            "CustomerId int, FirstName string, LastName string, Country string",
        ),
        "Invoice": frame(
            [
                (1, 1, day("2021-01-02"), "Brazil", 2.98),
                (2, 2, day("2021-05-02"), "Brazil", 2.98),
                (3, 3, day("2021-12-31"), "Norway", 0.99),
                (4, 3, day("2023-01-01"), "Norway", 3.96),
                (5, 5, day("2023-07-01"), "Chile", 1.99),
                (6, 4, day("2021-06-30"), "Norway", 0.99),
            ],
            "InvoiceId int, CustomerId int, InvoiceDate timestamp_ntz, BillingCountry string, Total double",
        ),
        "InvoiceLine": frame(
            [
                (1, 1, 1, 0.99, 1),
                (2, 1, 2, 1.99, 1),
                (3, 2, 1, 0.99, 1),
                (4, 2, 2, 1.99, 1),
                (5, 3, 1, 0.99, 1),
                (6, 4, 1, 0.99, 4),
                (7, 5, 2, 1.99, 1),
                (8, 6, 4, 0.99, 1),
            ],
            "InvoiceLineId int, InvoiceId int, TrackId int, UnitPrice double, Quantity int",
        ),
        "Employee": frame([(1, "Boss", "The")], "EmployeeId int, LastName string, FirstName string"),
        "MediaType": frame([(1, "File")], "MediaTypeId int, Name string"),
    }


@pytest.fixture(scope="session")
def music(music_tables):
    from starqa.sources.warehouse import star_of_music

    return star_of_music(music_tables)


@pytest.fixture(scope="session")
def music_tasks(music):
    from starqa.plans.tasks import build_tasks

    return build_tasks(music)
