"""Data-quality reports and the query-log audit on frames with known faults."""

from starqa.operators import audit
from starqa.operators.joins import duplicate_keys, unique_on
from starqa.plans import quality
from starqa.sources.schemas import MUSIC_STORE, TableSpec
from starqa.sources.warehouse import star_of_music

import pytest
from pyspark.sql import functions as F


# Expected sizes of the standard music-store sample
MUSIC_STORE_ROW_COUNTS = {
    "Album": 347,
    "Artist": 275,
    "Customer": 59,
    "Employee": 8,
    "Genre": 25,
    "Invoice": 412,
    "InvoiceLine": 2240,
    "MediaType": 5,
    "Playlist": 18,
    "PlaylistTrack": 8715,
    "Track": 3503,
}


def test_counts_and_expectations(spark, music_tables):
    counts = quality.table_counts(music_tables)
    assert {r.table_name: r.row_count for r in counts.collect()}["InvoiceLine"] == 8
    expected = spark.createDataFrame(list(MUSIC_STORE_ROW_COUNTS.items()), "table_name string, expected_rows bigint")
    kinds = {r.table_name: r.kind for r in quality.unexpected_counts(counts, expected).collect()}
    assert kinds["Playlist"] == "missing" and kinds["Album"] == "other size"
    exact = counts.withColumnRenamed("row_count", "expected_rows")
    assert quality.unexpected_counts(counts, exact).count() == 0
    none = quality.table_counts({"Album": music_tables["Album"].limit(0)})
    wanted = spark.createDataFrame([("Album", 3)], "table_name string, expected_rows bigint")
    assert quality.unexpected_counts(none, wanted).first().kind == "empty"


def test_profile(music_tables):
    rows = {(r.table_name, r.column_name): r for r in quality.profile_tables(music_tables, MUSIC_STORE).collect()}
    assert rows["Customer", "LastName"].null_count == 1
    assert rows["Customer", "CustomerId"].is_primary_key
    assert rows["Track", "GenreId"].refers_to == "Genre(GenreId)"
    assert (rows["Invoice", "Total"].data_type, rows["Invoice", "Total"].row_count) == ("double", 6)


def test_profile_by_sketch_and_exactly(spark, music_tables):
    """Exact counts leave nulls out; sketches stay within their bound; a primary key may not be null."""
    spec = TableSpec("k bigint, s string, d date, x double", "k")
    df = spark.range(30_000).select(
        F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, (F.col("id") % 7000).cast("string")).alias("s"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("d"), F.lit(None).cast("double").alias("x"),
    )
    exact = {r.column_name: r for r in quality.profile_tables({"t": df}, {"t": spec}).collect()}
    assert {c: r.distinct_count for c, r in exact.items()} == {"k": 30_000, "s": 7000, "d": 400, "x": 0}
    assert {c: r.nullable for c, r in exact.items()} == {"k": False, "s": True, "d": True, "x": True}
    for r in quality.profile_tables({"t": df}, {"t": spec}, distinct="sketch").collect():
        wanted = exact[r.column_name]
        assert abs(r.distinct_count - wanted.distinct_count) <= quality.SKETCH_ERROR * wanted.distinct_count
        assert (r.row_count, r.null_count, r.position) == (wanted.row_count, wanted.null_count, wanted.position)
    with pytest.raises(ValueError):
        quality.profile_tables({"t": df}, {"t": spec}, distinct="roughly")


def test_sample_rows(music_tables):
    rows = {(r.table_name, r["sample"]): r.text for r in quality.sample_rows(music_tables, MUSIC_STORE, 2).collect()}
    assert rows["Genre", 1].startswith("GenreId=1, Name='") and rows["Genre", 2].startswith("GenreId=2, ")
    assert any("LastName=None" in t for (name, _), t in {**rows, **{(r.table_name, r["sample"]): r.text for r in quality.sample_rows(music_tables, MUSIC_STORE, 99).collect()}}.items() if name == "Customer")
    assert max(n for _, n in rows) == 2


def test_keys_of_other_types_and_hot_keys(spark):
    """A child's key is cast to its parent's type; a key with most rows, null keys and a table that is child and parent."""
    layout = {
        "parent": TableSpec("id bigint, up int", "id", (("up", "parent", "id"),)),
        "child": TableSpec("ref string", None, (("ref", "parent", "id"),)),
    }
    tables = {
        "parent": spark.createDataFrame([(1, None), (2, 1), (3, 9)], "id bigint, up int"),
        "child": spark.range(5000).select(F.when(F.col("id") % 10 > 0, "2").when(F.col("id") > 100, "07").alias("ref")),
    }
    found = {(r.reference, r.kind, r.key) for r in quality.key_mismatches(tables, layout).collect()}
    to_parent, up = "child.ref -> parent.id", "parent.up -> parent.id"
    assert found == {
        (to_parent, "orphan", "7"), (to_parent, "childless", "1"), (to_parent, "childless", "3"),
        (up, "orphan", "9"), (up, "childless", "2"), (up, "childless", "3"),
    }


def test_keys(spark, music_tables):
    assert quality.repeated_keys(music_tables, MUSIC_STORE).count() == 0
    twice = {**music_tables, "Genre": music_tables["Genre"].union(music_tables["Genre"].limit(1))}
    assert [(r.table_name, r.key, r.n) for r in quality.repeated_keys(twice, MUSIC_STORE).collect()] == [("Genre", "1", 2)]
    broken = {**music_tables, "Invoice": music_tables["Invoice"].filter("InvoiceId <> 6")}
    found = {(r.reference, r.kind, r.key) for r in quality.key_mismatches(broken, MUSIC_STORE).collect()}
    assert ("InvoiceLine.InvoiceId -> Invoice.InvoiceId", "orphan", "6") in found
    assert ("Invoice.CustomerId -> Customer.CustomerId", "childless", "4") in found
    assert ("Track.GenreId -> Genre.GenreId", "childless", "3") in found


def test_unique_on(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert [(r.k, r.n) for r in duplicate_keys(df, "k").collect()] == [(2, 2)]
    assert {(r.k, r.v) for r in unique_on(df.filter("v <> 'c'"), "k").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="k repeats: 2"):
        unique_on(df, "k").collect()


def test_reconciliation(music, music_tables):
    assert quality.unreconciled_invoices(music).count() == 0
    changed = music_tables["Invoice"].withColumn(
        "Total", F.when(F.col("InvoiceId") == 1, 3.0).otherwise(F.col("Total"))
    )
    faulty = star_of_music(
        {
            **music_tables,
            "Invoice": changed.filter("InvoiceId <> 2"),
            "InvoiceLine": music_tables["InvoiceLine"].filter("InvoiceId <> 3"),
        }
    )
    kinds = {r.invoice_id: r.kind for r in quality.unreconciled_invoices(faulty).collect()}
    assert kinds == {1: "mismatch", 2: "no stated", 3: "no computed"}


def test_country_mismatch(music, music_tables):
    invoices = music_tables["Invoice"].selectExpr(
        "InvoiceId as invoice_id", "CustomerId as customer_id", "BillingCountry as billing_country"
    )
    found = quality.country_mismatches(invoices, music.customer.select("customer_id", "country"))
    assert [(r.invoice_id, r.country) for r in found.collect()] == [(5, None)]


def test_years(music):
    rows = {r.year: (r.invoices, r.lines) for r in quality.sales_by_year(music).collect()}
    assert rows == {2021: (4, 6), 2023: (2, 2)}
    dates = quality.date_range(music).first()
    assert (dates.first_date.isoformat()[:10], dates.last_date.isoformat()[:10]) == ("2021-01-02", "2023-07-01")
    assert quality.undated_invoices(music).count() == 0
    placed = quality.absent_in_ranking(music, 3).collect()
    assert [(r.customer_id, r.lo) for r in placed if r.customer_id == 5] and all(r.lo <= r.hi for r in placed)
    absent = quality.absent_customers(music).collect()
    assert [(r.customer_id, r.customer_name, r.last_year_invoices) for r in absent] == [(5, "Ed Nomad", 1)]


def test_incomplete_tasks(music_tasks):
    from dataclasses import replace

    cut = replace(music_tasks, truth=music_tasks.truth.filter("role <> 'member' and lo = 0"))
    problems = {r.problem for r in quality.incomplete_tasks(cut).collect()}
    assert problems == {"no entities", "bands too short"}
    wrong = replace(
        music_tasks,
        tasks=music_tasks.tasks.withColumn("value", F.lit(None).cast("double")).withColumn("n_truth", F.col("n_truth") + 1),
    )
    rows = quality.incomplete_tasks(wrong).collect()
    assert {r.problem for r in rows} == {"no value", "entities miscounted"} and len(rows) == music_tasks.tasks.count()


READS = [
    (1, "Customer", "LastName"), (1, "Customer", "LastName"), (1, "Customer", None), (1, "Invoice", ""),
    (2, "sqlite_master", "name"), (3, "SQLITE_schema", ""), (3, "Track", "Name"), (4, "", "x"), (5, None, None),
]


def test_read_audit(spark):
    reads = spark.createDataFrame(READS, "query_id int, table string, column string")
    rows = {r.query_id: r for r in audit.read_audit(reads).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].tables_read == ["Customer", "Invoice"]
    assert [tuple(c) for c in rows[1].columns_read] == [("Customer", "LastName")]
    assert rows[2].tables_read == [] and rows[2].metadata_tables_read == ["sqlite_master"]
    assert not rows[2].touched_real_tables and rows[3].touched_real_tables
    log = spark.createDataFrame([(i,) for i in range(1, 7)], "query_id int")
    marked = {r.query_id: r.grounded for r in audit.grounded(log, reads).collect()}
    assert marked == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_outcomes(spark):
    log = spark.createDataFrame(
        [
            (1, "q", True, [], 50, True, None, None, 0.5, [], [], []),
            (2, "q", True, [], 7, False, None, None, 0.1, [], [], []),
            (3, "q", False, [], 0, False, "m", "timeout", 5.0, [], [], []),
        ],
        audit.result_log_schema(),
    )
    rows = {r.outcome: tuple(r)[1:] for r in audit.outcome_summary(log).collect()}
    assert rows == {"ok": (2, 57, 1, 0.5), "timeout": (1, 0, 0, 5.0)}
