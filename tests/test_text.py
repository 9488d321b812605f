"""Numbers, lists and names read out of free text."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from starqa.functions.answers import clean_item, parse_list, parse_numeric
from starqa.functions.names import alias_set, full_name, normalize, normalize_all


def applied(spark, texts, of):
    """The column function on each text, in order."""
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.v for r in df.select("i", of(F.col("t")).alias("v")).orderBy("i").collect()]


NUMBERS = [
    ("1234.56", 1234.56),
    ("$1,234.56", 1234.56),
    ("The total was 1234.56 dollars.", 1234.56),
    ("  42 ", 42.0),
    ("1234.56\n", 1234.56),
    ('{"total": 1234.56}', 1234.56),
    ('{"q1": 7}', 7.0),
    ('{"a": 5, "b": 5}', 5.0),
    ('{"a": 5, "b": 6}', None),
    ('{"q1": true}', 1.0),
    ('{"total": "12"}', 12.0),
    ('{"q1": 7} and so', None),
    ("[5]", 5.0),
    ("1e5", 100000.0),
    ("-3.5", -3.5),
    ("5 or 5.0", 5.0),
    ("-0 or 0", 0.0),
    ("٤٢ items", 42.0),
    ("either 100 or 200", None),
    ("no idea", None),
    ("true", None),
    ("", None),
    ("   ", None),
    (None, None),
]


def test_parse_numeric(spark):
    found = applied(spark, [t for t, _ in NUMBERS], parse_numeric)
    assert found == [n for _, n in NUMBERS]


NAMES = ["Alice Smith", "Bob Jones", "Carla Diaz"]
LISTS = [
    ("1. Alice Smith\n2. Bob Jones\n3. Carla Diaz", NAMES),
    ("1) Alice Smith\r\n2) Bob Jones\r\n\r\n3) Carla Diaz\r\n", NAMES),
    ("- Alice Smith\n* Bob Jones\n• Carla Diaz", NAMES),
    ("Alice Smith, Bob Jones, Carla Diaz", NAMES),
    ('["Alice Smith", "Bob Jones", "Carla Diaz"]', NAMES),
    ('{"n": 3, "b": ["Alice Smith", "Bob Jones", "Carla Diaz"], "a": ["no"]}', NAMES),
    ("1. Alice Smith ($49.62)\n2. Bob Jones [$43.62]\n3. Carla Diaz ($39.62)", NAMES),
    ("1. Alice Smith - 49.62\n2. Bob Jones: $43.62\n3. Carla Diaz – 1,039.62", NAMES),
    ('"Alice Smith", \'Bob Jones\', Carla Diaz (a, b)', NAMES),
    ("x (a, b), y (c (d), e), z", ["x", "y", "z"]),
    ("x), y, z (", ["x)", "y", "z ("]),
    ("x, y), z", ["x, y)", "z"]),
    ("['a', 'b']", ["['a", "b']"]),
    ("[1] Rock [2]", []),
    ('["a", "b"', ['["a', "b"]),
    ('[1, 2.50, 1.0, true, null, " ", ""]', ["1", "5", "0", "True", "None"]),
    ('["(x)", "a"]', ["", "a"]),
    ('{"a": 1}', ['{"a": 1}']),
    ("{not json}, b", ["{not json}", "b"]),
    (",,a,,", ["a"]),
    ("Foo (a) bar (b)", ["Foo"]),
    ("a b", ["a", "b"]),
    ("", []),
    ("  \n ", []),
    (None, []),
]


def test_parse_list(spark):
    assert applied(spark, [t for t, _ in LISTS], parse_list) == [n for _, n in LISTS]


def test_clean_item(spark):
    cases = {"  3) 'Foo' ": "Foo", "• Foo - $1,200": "Foo", "Foo (": "Foo (", "1.": "", "a - b": "a - b"}
    assert applied(spark, list(cases), clean_item) == list(cases.values())


def test_long_texts_do_not_exhaust_the_stack(spark):
    long = ["x," * 50_000 + ")", "(" * 20_000, '{"' + "a" * 50_000 + '": 1}', "a " * 50_000]
    lists = applied(spark, long, parse_list)
    assert len(lists[0]) == 1 and lists[1] == ["(" * 20_000]
    assert applied(spark, long, parse_numeric)[2] == 1.0


NORMALISED = [
    ("Antônio Carlos  Jobim.", "antonio carlos jobim"),
    ("  AC/DC ", "ac dc"),
    ("Jane_Doe!", "jane_doe"),
    ("Straße №²", "strasse no2"),
    ("ÀÉ", "ae"),
    (" Tab\there\x1f", "tab here"),
    ("日本 語", "日本 語"),
    ("---", ""),
    ("", ""),
    (None, None),
]


def test_normalize(spark):
    texts = [t for t, _ in NORMALISED]
    assert applied(spark, texts, normalize) == [n for _, n in NORMALISED]


def test_normalize_all_equals_normalize(spark):
    texts = [t for t, _ in NORMALISED if t is not None]
    df = spark.createDataFrame([(texts,), ([],), (None,), (["A", "b."],)], "ts array<string>")
    rows = [r[0] for r in df.select(normalize_all(F.col("ts"))).collect()]
    assert rows == [[n for t, n in NORMALISED if t is not None], [], None, ["a", "b"]]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_accents_fold_in_both_forms(spark, form):
    text = unicodedata.normalize(form, "Café Zoë")
    assert applied(spark, [text], normalize) == ["cafe zoe"]


def test_names_and_aliases(spark):
    df = spark.createDataFrame([("Ana", None), (None, "Lund"), (None, None)], "a string, b string")
    names = [r[0] for r in df.select(full_name(F.col("a"), F.col("b"))).collect()]
    assert names == ["Ana", "Lund", ""]
    made = spark.range(1).select(
        alias_set(F.lit("Ana Silva"), F.lit("7"), F.lit("SILVA"), F.lit("ana silva"), F.lit("--"))
    )
    assert made.first()[0] == ["ana silva", "7", "silva"]


def test_folding_holds_a_part_of_a_text(spark):
    """A long text with accents is folded in parts; its words are not held as a list."""
    import tracemalloc

    import pandas as pd
    from starqa.functions import names as module

    fold = module._fold_text.func
    text = "Ünï-cödé  wörds, \u00a8 e\u0301 " * 100_000
    tracemalloc.start()
    got = fold(pd.Series([text, None, "\u3000"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == " ".join(["uni code words e"] * 100_000) and got[1] is None and got[2] == ""
    assert peak < 12 * len(text)


def test_lists_parse_json_once_for_each_kind(spark):
    """A JSON list is parsed once, an object once as a whole; an item's kind is looked up once."""
    from starqa.functions.answers import parse_list

    plan = spark.range(1).select(parse_list(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert (plan.count("try_parse_json("), plan.count("btrim(cast(id")) == (2, 1)
