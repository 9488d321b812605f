"""Name normalisation and display names as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ASCII_ONLY = r"^[\x00-\x7f]*$"


def _python_folding():
    """The two Arrow functions for text that is not plain ASCII.

    They are closures, so that Spark ships their code to the workers by value
    and no package has to be installed there.  Texts are folded one by one: what
    a worker holds beside a batch and its result is a part of one text.
    """

    def fold(text):
        import re
        import unicodedata

        folded, start = [], 0
        while start < len(text):
            # A long text is folded in parts that end before a space: no letter is joined with what stands beyond one.
            end = text.find(" ", start + 65536)
            end = end if end >= 0 else len(text)
            plain = unicodedata.normalize("NFKD", text[start:end])
            marks = {ord(c): None for c in set(plain) if unicodedata.combining(c)}
            words = re.sub(r"\W+", " ", plain.translate(marks) if marks else plain).strip(" ")
            if words:
                folded.append(words.casefold())
            start = end
        return " ".join(folded)

    def fold_text(texts: pd.Series) -> pd.Series:
        return texts.astype(object).map(fold, na_action="ignore")

    def fold_texts(lists: pd.Series) -> pd.Series:
        folded = [None if items is None else [fold(item) for item in items if item is not None] for items in lists]
        return pd.Series(folded, index=lists.index, dtype=object)

    text = T.StringType()
    return F.pandas_udf(fold_text, text), F.pandas_udf(fold_texts, T.ArrayType(text))


_fold_text, _fold_texts = _python_folding()


def _fold_ascii(col: Column) -> Column:
    spaced = F.regexp_replace(col, r"[^A-Za-z0-9_]+", " ")
    return F.lower(F.trim(spaced))


def normalize(col: Column) -> Column:
    """Fold accents, case, punctuation and spacing of a name.

    ASCII rows stay in the JVM; only the others cross to Python, in Arrow
    batches (the ASCII ones travel as nulls).
    """
    ascii_row = col.rlike(ASCII_ONLY)
    return F.when(ascii_row, _fold_ascii(col)).otherwise(
        _fold_text(F.when(~ascii_row, col))
    )


def normalize_all(items: Column) -> Column:
    """:func:`normalize` over an array column, element by element."""
    ascii_row = F.array_join(items, "").rlike(ASCII_ONLY)
    return F.when(ascii_row, F.transform(items, _fold_ascii)).otherwise(
        _fold_texts(F.when(~ascii_row, items))
    )


def full_name(first: Column, last: Column) -> Column:
    """First and last name with a missing part read as empty, trimmed."""
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))


def alias_set(*spellings: Column) -> Column:
    """Distinct normalised spellings of one entity, empty ones removed."""
    norms = normalize_all(F.array_compact(F.array(*spellings)))
    return F.array_remove(F.array_distinct(norms), "")


def order_text(key: Column) -> Column:
    """An integer key as text that sorts like the integer."""
    return F.lpad(key.cast("string"), 20, "0")
