"""Reading numbers and lists of names out of free text, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from starqa import fixed_values as fixed

# Marks a comma that sits inside parentheses while a line is being split; a
# noncharacter, so it never stands in stored text.
HELD_COMMA = "\ufdd0"


def strip(col: Column) -> Column:
    """Trim every kind of white space from both ends."""
    return F.btrim(col, F.lit(fixed.WS_CHARS))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@lru_cache(maxsize=1)
def _other_digits() -> tuple[str, str]:
    """All non-ASCII decimal digits and the ASCII digit each stands for."""
    chars = [
        chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"
    ]
    return "".join(chars), "".join(str(unicodedata.digit(c)) for c in chars)


def _ascii_digits(text: Column) -> Column:
    source, target = _other_digits()
    return F.when(
        text.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(text, source, target)
    ).otherwise(text)


def _json_members(text: Column) -> Column:
    """Key to value of a JSON object in written order; null if not an object."""
    # Wrapped in a list of one, so that trailing text makes the JSON invalid.
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    outer = F.try_parse_json(wrapped).try_cast("array<variant>")
    parsed = F.from_json(
        F.when(F.size(outer) == 1, wrapped),
        "array<map<string,variant>>",
        {"allowSingleQuotes": "false"},
    )
    # A map keeps the order of the keys, which a variant does not.
    return F.get(parsed, F.lit(0))


def _one_member_number(text: Column) -> Column:
    """The number in a one-key JSON object, else null."""
    members = _json_members(text)
    only = F.get(F.map_values(members), F.lit(0))
    numeric = F.schema_of_variant(only).rlike("^(?:BIGINT|DOUBLE|DECIMAL)")
    return F.when((F.size(members) == 1) & numeric, F.try_variant_get(only, "$", "double"))


def parse_numeric(answer: Column) -> Column:
    """The one number a text states, else null.

    A JSON number, or a one-key JSON object holding a number, is that number.
    Otherwise every number in the text counts, thousands commas removed, and
    they must all be equal.
    """
    text = strip(answer)
    found = F.transform(
        F.regexp_extract_all(_ascii_digits(answer), F.lit(fixed.NUMBER), 0),
        # adding zero turns a negative zero into zero, so the two count as one
        lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double") + F.lit(0.0),
    )
    stated = with_value(
        F.array_distinct(found), lambda ns: F.when(F.size(ns) == 1, F.get(ns, F.lit(0)))
    )
    return (
        F.when(text.rlike(rf"^{fixed.JSON_NUMBER}$"), text.try_cast("double"))
        .when(text.isin("NaN", "Infinity", "-Infinity"), text.try_cast("double"))
        .when(
            text.rlike(r"(?s)^\{.*\}$"), F.coalesce(_one_member_number(text), stated)
        )
        .otherwise(stated)
    )


def clean_item(item: Column) -> Column:
    """One list item without its number or bullet, trailing note and quotes."""
    # Only an item that ends in a bracket can carry a note; checking that first
    # keeps long texts with many brackets linear.
    noted = with_value(
        F.regexp_replace(strip(item), fixed.ITEM_PREFIX, ""),
        lambda bare: F.when(
            bare.endswith(")") | bare.endswith("]"), F.regexp_replace(bare, fixed.TRAILING_NOTE, "")
        ).otherwise(bare),
    )
    named = F.regexp_replace(noted, fixed.TRAILING_FIGURE, "")
    return strip(F.btrim(strip(named), F.lit("\"'")))


def _variant_text(item: Column) -> Column:
    """A JSON list item the way the language of the answers prints it."""
    text = F.try_variant_get(item, "$", "string")
    return with_value(
        F.schema_of_variant(item),
        lambda kind: F.when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind.rlike(r"^DECIMAL\((?:[1-9]|1[0-8]),0\)$"), F.concat(text, F.lit(".0")))
        .otherwise(text),
    )


def _json_list(text: Column) -> Column:
    """Items of a JSON array, or of the first array in a JSON object; else null."""
    outer = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).try_cast("array<variant>")
    array = with_value(outer, lambda items: F.when(F.size(items) == 1, F.get(items, F.lit(0))))
    arrays = F.filter(
        F.map_values(_json_members(text)),
        lambda v: F.schema_of_variant(v).startswith("ARRAY"),
    )
    chosen = F.when(text.startswith("["), array).otherwise(F.get(arrays, F.lit(0)))
    # Each item is worked out once, not once more for being looked at.
    items = with_value(
        F.transform(chosen.try_cast("array<variant>"), _variant_text), lambda ts: F.filter(ts, lambda i: strip(i) != "")
    )
    return F.transform(items, clean_item)


def _split_commas(text: Column) -> Column:
    """Split on commas, except one whose next parenthesis is a closing one."""
    pieces = F.regexp_extract_all(text, F.lit(r"[^()]*+[()]?"), 0)
    held = F.transform(
        pieces,
        lambda p: F.when(p.endswith(")"), F.replace(p, F.lit(","), F.lit(HELD_COMMA))).otherwise(p),
    )
    inside = F.transform(
        F.split(F.array_join(held, ""), ","),
        lambda i: F.replace(i, F.lit(HELD_COMMA), F.lit(",")),
    )
    return F.when(text.contains(")"), inside).otherwise(F.split(text, ","))


def parse_list(answer: Column) -> Column:
    """Names listed in a text, in order: JSON, lines, or comma-separated."""
    return with_value(strip(answer), _names_in)


def _names_in(text: Column) -> Column:
    lines = F.filter(
        F.transform(F.split(text, fixed.LINE_BREAK), strip), lambda line: line != ""
    )
    parts = with_value(
        lines, lambda several: F.when(F.size(several) > 1, several).otherwise(_split_commas(text))
    )
    written = F.filter(F.transform(parts, clean_item), lambda i: i != "")
    maybe_json = text.rlike(r"(?s)^(?:\[.*\]|\{.*\})$")
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(maybe_json, F.coalesce(_json_list(text), written))
        .otherwise(written)
    )
