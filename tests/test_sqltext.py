"""Screening of logged SQL."""

import pytest
from pyspark.sql import functions as F

from starqa.functions.sqltext import screen, scrub

REJECTED = {
    "DROP TABLE Customer": "disallowed_statement",
    "DELETE FROM Customer": "disallowed_statement",
    "DELETE FROM Customer WHERE CustomerId = 1": "disallowed_statement",
    "UPDATE Customer SET LastName = 'x'": "disallowed_statement",
    "INSERT INTO Genre (Name) VALUES ('x')": "disallowed_statement",
    "REPLACE INTO Genre (GenreId, Name) VALUES (1, 'x')": "disallowed_statement",
    "CREATE TABLE evil (a INT)": "disallowed_statement",
    "CREATE VIEW evil AS SELECT 1": "disallowed_statement",
    "ALTER TABLE Customer ADD COLUMN evil TEXT": "disallowed_statement",
    "ATTACH DATABASE '/tmp/evil.db' AS evil": "disallowed_statement",
    "DETACH DATABASE main": "disallowed_statement",
    "PRAGMA writable_schema = ON": "disallowed_statement",
    "VACUUM": "disallowed_statement",
    "REINDEX": "disallowed_statement",
    "ANALYZE": "disallowed_statement",
    "BEGIN; DELETE FROM Customer; COMMIT": "multiple_statements",
    "WITH t AS (SELECT 1) INSERT INTO Genre SELECT 99, 'x'": "forbidden_keyword",
    "SELECT 1; DROP TABLE Customer": "multiple_statements",
    "SELECT 1;\n-- innocuous\nDROP TABLE Customer": "multiple_statements",
    "select 1; drop table Customer": "multiple_statements",
    "SELECT load_extension('/tmp/evil.so')": "forbidden_function",
    "SELECT writefile('/tmp/pwned', 'x')": "forbidden_function",
    "SELECT readfile('/etc/passwd')": "forbidden_function",
    "": "empty_query",
    "   ": "empty_query",
    "-- just a comment": "empty_query",
    "/* nothing */": "empty_query",
    ";;": "empty_query",
    "123": "empty_query",
}
ACCEPTED = {
    "SELECT 'DROP TABLE Customer' AS harmless": "SELECT",
    "SELECT CASE WHEN Total > 5 THEN 'big' ELSE 'small' END AS b, replace(a, 'b', 'c') FROM t": "SELECT",
    "SELECT COUNT(*) FROM Invoice": "SELECT",
    "  with t as (select 1) select * from t ;": "WITH",
    "EXPLAIN QUERY PLAN SELECT * FROM Customer": "EXPLAIN",
    "VALUES (1)": "VALUES",
    'SELECT "drop", [delete], `vacuum` FROM t': "SELECT",
    # a comment mark inside a literal hides the rest of its line
    "SELECT 'a -- b' ; DROP TABLE t": "SELECT",
}


@pytest.fixture(scope="module")
def verdicts(spark):
    log = spark.createDataFrame([(s,) for s in (*REJECTED, *ACCEPTED)], "sql string")
    return {r.sql: r for r in screen(log).collect()}


@pytest.mark.parametrize("statement", REJECTED)
def test_rejected(verdicts, statement):
    row = verdicts[statement]
    assert row.reason == REJECTED[statement]
    assert len(row.message) > 20


@pytest.mark.parametrize("statement", ACCEPTED)
def test_accepted(verdicts, statement):
    row = verdicts[statement]
    assert (row.reason, row.message, row.leading_keyword) == ("ok", None, ACCEPTED[statement])


def test_denied_words_are_listed_in_order(spark):
    log = spark.createDataFrame(
        [("select vacuum, DROP, drop from t",), ("select writefile(x), EDIT(y)",), (None,)], "sql string"
    )
    rows = screen(log).collect()
    assert rows[0].denied == ["DROP", "VACUUM"]
    assert rows[0].message.startswith("Query contains forbidden keyword(s): DROP, VACUUM.")
    assert rows[1].denied == ["edit", "writefile"]
    assert rows[2].reason == "empty_query"


def test_scrub(spark):
    texts = {
        "a 'b''c' d": "a  ''  d",
        "'a''''b'": " '' ",
        "'a'\"b\"": " ''  '' ",
        "'a' 'b'": " ''   '' ",
        "'open": "'open",
        "x /* 'a\n b' */ y": "x   y",
        "it's -- 'x'\n'": "it '' ",
    }
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.orderBy("i").select(scrub(F.col("t"))).collect()
    assert [r[0] for r in rows] == list(texts.values())


def test_scrub_of_a_long_literal(spark):
    long = "select '" + "it''s " * 30_000 + "' from t"
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(scrub(F.col("t"))).first()[0] == "select  ''  from t"
