"""Compare the queries with their SQL: ``python -m checks.compare [folder] [names...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or value.__class__.__name__ == "Decimal":
        number = float(value)
        return "nan" if math.isnan(number) else repr(number)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def mismatch(spark, folder: str, name: str, connection) -> tuple[str | None, int]:
    """What differs between a query and its SQL, or None, and the row count."""
    df = QUERIES[name](spark, folder)
    ours = _rows(df.columns, df.collect())
    cursor = connection.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = _rows(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}", len(ours)
    if ours != theirs:
        extra = [r for r in ours if r not in set(theirs)][:2]
        lacking = [r for r in theirs if r not in set(ours)][:2]
        return f"{len(ours)} / {len(theirs)} rows; only here {extra}; only there {lacking}", len(ours)
    return None, len(ours)


def connect(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def main() -> None:
    from bench import session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection = session(), connect(folder)
    bad = 0
    for name in names:
        start, rows = time.time(), 0
        try:
            if name in ORACLES:
                found, rows = mismatch(spark, folder, name, connection)
            else:
                rows = QUERIES[name](spark, folder).count()
                found = None if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {rows:7d} rows {(found or 'same')[:900]}", flush=True)
    print(f"{len(names) - bad} of {len(names)} same")


if __name__ == "__main__":
    main()
