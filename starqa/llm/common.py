"""What several operators of this package need."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space; in Python, ``bytes.split``.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are worked on in groups of about this many bytes, whatever Arrow hands over.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; none if it is null."""
    return text.encode().split() if text else []


def row_mark(text: Column) -> Column:
    """A hash that tells rows of one id but different texts apart."""
    return F.xxhash64(text)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about ``limit`` bytes of text each, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        for row, value in enumerate(column):
            length = 0 if not value.is_valid else value.as_buffer().size
            if row > start and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if batch.num_rows > start:
            yield batch.slice(start)


def is_training(doc_id: Column, parts: int, held_out: int) -> Column:
    """True where crc32 of the id as text, modulo ``parts``, is not ``held_out``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != held_out
