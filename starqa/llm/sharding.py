"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starqa.llm.common import row_mark
from starqa.sources.storage import stored


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds, row by row, the partition and the bytes and rows before it there."""
    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        size = batch.column(batch.schema.get_field_index("size")).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64) + size_before
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(np.full(n, part, np.int32)),
                pa.array(ends - size),
                pa.array(np.arange(rows_before, rows_before + n, dtype=np.int64)),
            ],
            names=[*batch.schema.names, "part", "size_before", "rows_before"],
        )
        if n:
            size_before, rows_before = int(ends[-1]), rows_before + n


def byte_shards(documents: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its shard and its place there.

    Documents are ordered by id (nulls first), then by a hash of the text.
    Shards are contiguous in that order: a document goes to the shard in whose
    equal share of all bytes its own middle byte falls, so a shard is off its
    share by at most the size of one document at either end.

    The order comes from a range partitioning of slim rows, written once.  Only
    totals, one row per partition, meet in one task; every document then adds
    the bytes before its partition to those before it there.  Equal rows are
    dealt over partitions by their place in the input, so no key is too large.

    Size: UTF-8 bytes plus 1; a null text has none.  An empty table gives no
    rows.  Columns of the input besides id and text are not used.
    """
    slim = documents.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(row_mark(F.col(text)), F.lit(0)).alias("mark"),
    ).withColumn("place", F.monotonically_increasing_id())
    order = ["doc_id", "mark", "place"]
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("mark", "place")
    kind = ranged.schema["doc_id"].dataType.simpleString()
    rows = stored(
        ranged.mapInArrow(
            _running,
            f"doc_id {kind}, size long, text_crc32 long, part int, size_before long, rows_before long",
        ),
        "byte-order",
    )
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("part_start"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("part_row"),
        F.sum("part_size").over(Window.partitionBy()).alias("all_size"),
    )
    placed = rows.join(starts, "part").select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr("part_row + rows_before").alias("row"),
        F.least(F.lit(shards - 1), F.expr(f"(2 * (part_start + size_before) + size) * {shards} div (2 * all_size)")).cast("int").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", F.expr("row - first_row").alias("slot")
    )
