"""Declared schemas and keys of the two supported warehouse layouts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Columns of one table, its primary key and where its foreign keys point."""

    schema: str
    primary_key: str | None = None
    foreign_keys: tuple[tuple[str, str, str], ...] = ()

    def struct(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)


# --------------------------------------------------------------------------
# Table and column names of the music-store layout
# --------------------------------------------------------------------------

MUSIC_STORE = {
    "Album": TableSpec(
        "AlbumId int, Title string, ArtistId int",
        "AlbumId",
        (("ArtistId", "Artist", "ArtistId"),),
    ),
    "Artist": TableSpec("ArtistId int, Name string", "ArtistId"),
    "Customer": TableSpec(
        "CustomerId int, FirstName string, LastName string, Country string", "CustomerId"
    ),
    "Employee": TableSpec("EmployeeId int, LastName string, FirstName string", "EmployeeId"),
    "Genre": TableSpec("GenreId int, Name string", "GenreId"),
    "Invoice": TableSpec(
        "InvoiceId int, CustomerId int, InvoiceDate timestamp_ntz, "
        "BillingCountry string, Total double",
        "InvoiceId",
        (("CustomerId", "Customer", "CustomerId"),),
    ),
    "InvoiceLine": TableSpec(
        "InvoiceLineId int, InvoiceId int, TrackId int, UnitPrice double, Quantity int",
        "InvoiceLineId",
        (("InvoiceId", "Invoice", "InvoiceId"), ("TrackId", "Track", "TrackId")),
    ),
    "MediaType": TableSpec("MediaTypeId int, Name string", "MediaTypeId"),
    "Track": TableSpec(
        "TrackId int, Name string, AlbumId int, GenreId int",
        "TrackId",
        (("AlbumId", "Album", "AlbumId"), ("GenreId", "Genre", "GenreId")),
    ),
}

ORDERS = {
    "region": TableSpec("r_regionkey int, r_name string", "r_regionkey"),
    "nation": TableSpec(
        "n_nationkey int, n_name string, n_regionkey int",
        "n_nationkey",
        (("n_regionkey", "region", "r_regionkey"),),
    ),
    "customer": TableSpec(
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
        "c_mktsegment string",
        "c_custkey",
        (("c_nationkey", "nation", "n_nationkey"),),
    ),
    "supplier": TableSpec(
        "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        "s_suppkey",
        (("s_nationkey", "nation", "n_nationkey"),),
    ),
    "part": TableSpec(
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double",
        "p_partkey",
    ),
    "orders": TableSpec(
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string",
        "o_orderkey",
        (("o_custkey", "customer", "c_custkey"),),
    ),
    # (l_orderkey, l_linenumber) is not unique, so lineitem has no key
    "lineitem": TableSpec(
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
        None,
        (
            ("l_orderkey", "orders", "o_orderkey"),
            ("l_partkey", "part", "p_partkey"),
            ("l_suppkey", "supplier", "s_suppkey"),
        ),
    ),
}
