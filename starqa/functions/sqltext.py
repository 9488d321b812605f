"""Screening of logged SQL text, as column expressions.

The result labels rows of a query log.  It is not a security boundary:
comments are removed before quoted text, so ``--`` inside a literal hides the
rest of that line from the screen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starqa import fixed_values as fixed
from starqa.functions.answers import strip

# Stand-ins for quoted text while it is being blanked; noncharacters, so they
# never stand in stored text.
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def scrub(sql: Column) -> Column:
    """SQL text with comments and quoted spans blanked out."""
    bare = F.regexp_replace(sql, fixed.SQL_BLOCK_COMMENT, " ")
    bare = F.regexp_replace(bare, fixed.SQL_LINE_COMMENT, " ")
    # A doubled quote inside a literal reads as two literals that touch, which
    # are merged afterwards.  Unlike a repeated group in the pattern, this needs
    # no stack depth that grows with the literal.
    marked = F.regexp_replace(
        bare,
        r"""(')[^']*'|(")[^"]*"|\[[^\]]*\]|`[^`]*`""",
        f"{OPEN}$1$2{CLOSE}",
    )
    for quote in "'\"":
        mark = f"{OPEN}{quote}{CLOSE}"
        marked = F.regexp_replace(marked, f"(?<={mark}){mark}", "")
    return F.regexp_replace(marked, f"{OPEN}['\"]?{CLOSE}", " '' ")


def statements(scrubbed: Column) -> Column:
    """Non-blank statements of a scrubbed text."""
    return F.filter(
        F.transform(F.split(scrubbed, ";"), strip), lambda part: part != ""
    )


def words(statement: Column) -> Column:
    """Bare words of one statement."""
    return F.regexp_extract_all(statement, F.lit(fixed.SQL_WORD), 0)


def _hits(found: Column, denied: tuple[str, ...]) -> Column:
    listed = F.array(*[F.lit(word) for word in denied])
    return F.array_sort(F.array_intersect(found, listed))


def screen(log, sql: str = "sql"):
    """Add the verdict on each statement of a log.

    New columns: ``scrubbed``, ``n_statements``, ``leading_keyword``,
    ``denied`` (words that caused a rejection), ``reason`` (``ok`` or a slug)
    and ``message``.
    """
    text = F.col(sql)
    parts = (
        log.withColumn("scrubbed", scrub(text))
        .withColumn("_parts", statements(F.col("scrubbed")))
        .withColumn("n_statements", F.coalesce(F.size("_parts"), F.lit(0)))
        .withColumn("_words", words(F.get("_parts", F.lit(0))))
        .withColumn("leading_keyword", F.upper(F.get("_words", F.lit(0))))
        .withColumn(
            "_keywords", _hits(F.transform("_words", F.upper), fixed.FORBIDDEN_KEYWORDS)
        )
        .withColumn(
            "_functions", _hits(F.transform("_words", F.lower), fixed.FORBIDDEN_FUNCTIONS)
        )
    )
    blank = text.isNull() | (strip(text) == "")
    no_words = F.col("leading_keyword").isNull()
    leading_ok = F.col("leading_keyword").isin(*fixed.ALLOWED_LEADING_KEYWORDS)
    reason = (
        F.when(blank | (F.col("n_statements") == 0), "empty_query")
        .when(F.col("n_statements") > 1, "multiple_statements")
        .when(no_words, "empty_query")
        .when(~leading_ok, "disallowed_statement")
        .when(F.size("_keywords") > 0, "forbidden_keyword")
        .when(F.size("_functions") > 0, "forbidden_function")
        .otherwise("ok")
    )
    listed = F.array_join("denied", ", ")
    message = (
        F.when(blank, fixed.MESSAGE_EMPTY)
        .when(F.col("n_statements") == 0, fixed.MESSAGE_NO_STATEMENT)
        .when(
            F.col("n_statements") > 1,
            F.format_string(fixed.MESSAGE_MULTIPLE, F.col("n_statements")),
        )
        .when(no_words, fixed.MESSAGE_NO_WORDS)
        .when(~leading_ok, F.format_string(fixed.MESSAGE_LEADING, F.col("leading_keyword")))
        .when(F.col("reason") == "forbidden_keyword", F.format_string(fixed.MESSAGE_KEYWORD, listed))
        .when(F.col("reason") == "forbidden_function", F.format_string(fixed.MESSAGE_FUNCTION, listed))
    )
    none = F.array().cast("array<string>")
    return (
        parts.withColumn("reason", reason)
        .withColumn(
            "denied",
            F.when(F.col("reason") == "forbidden_keyword", F.col("_keywords"))
            .when(F.col("reason") == "forbidden_function", F.col("_functions"))
            .otherwise(none),
        )
        .withColumn("message", message)
        .drop("_parts", "_words", "_keywords", "_functions")
    )
