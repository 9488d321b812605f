"""Audit of a query log: what each query read and how it ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starqa import fixed_values as fixed


def read_audit(reads: DataFrame) -> DataFrame:
    """Tables and columns each query read, catalogue tables kept apart.

    ``reads`` has query_id, table and column, one row per read; an empty or
    null column is a read of the table as such.  Repeated reads are removed
    before anything is collected, so a set holds at most the schema.
    """
    distinct = (
        reads.filter(F.coalesce(F.col("table"), F.lit("")) != "")
        .select("query_id", "table", "column")
        .distinct()
    )
    catalogue = F.lower("table").startswith(fixed.CATALOGUE_PREFIX)
    has_column = F.coalesce(F.col("column"), F.lit("")) != ""
    return (
        distinct.groupBy("query_id")
        .agg(
            F.array_sort(F.collect_set(F.when(~catalogue, F.col("table")))).alias("tables_read"),
            F.array_sort(
                F.collect_set(F.when(~catalogue & has_column, F.struct("table", "column")))
            ).alias("columns_read"),
            F.array_sort(F.collect_set(F.when(catalogue, F.col("table")))).alias(
                "metadata_tables_read"
            ),
        )
        .withColumn("touched_real_tables", F.size("tables_read") > 0)
    )


def grounded(log: DataFrame, reads: DataFrame) -> DataFrame:
    """The log with ``grounded``: whether the query read a base table at all."""
    base = (
        reads.filter(
            (F.coalesce(F.col("table"), F.lit("")) != "")
            & ~F.lower("table").startswith(fixed.CATALOGUE_PREFIX)
        )
        .select("query_id")
        .distinct()
        .withColumn("grounded", F.lit(True))
    )
    return log.join(base, "query_id", "left").withColumn(
        "grounded", F.coalesce("grounded", F.lit(False))
    )


def outcome_summary(log: DataFrame) -> DataFrame:
    """Per error type (``ok`` for none): queries, rows, cut results, time spent.

    ``log`` has ok, error_type, row_count, truncated and elapsed_s.
    """
    outcome = F.when(F.col("ok"), "ok").otherwise(F.col("error_type"))
    return log.groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("queries"),
        F.sum("row_count").alias("rows_returned"),
        F.count_if("truncated").alias("truncated"),
        F.max("elapsed_s").alias("slowest_s"),
    )


def result_log_schema() -> str:
    """Schema of a log of query outcomes."""
    return (
        "query_id bigint, sql string, ok boolean, columns array<string>, row_count bigint, "
        "truncated boolean, error string, error_type string, elapsed_s double, "
        "tables_read array<string>, columns_read array<struct<table:string,column:string>>, "
        "metadata_tables_read array<string>"
    )
