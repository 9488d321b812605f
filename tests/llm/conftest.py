import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"

#: Null and empty texts, blanks only, ties, repeated rows, a null id, a very long text, odd characters.
EDGES = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one two three four five six", "en", None, 27),
    (4, "one two three four five six", "en", None, 27),
    (5, "one two three four five six", None, "b", None),
    (None, "Ünïcode ▁ wörds\x00 \U0001f600 and 中文 text", "de", "b", 30),
    (None, None, None, None, None),
    (6, "word " * 20_000 + "x" * 30_000, "en", "a", 130_000),
    (7, "A|B # $ % & * < > |", "en", "c", 20),
]


@pytest.fixture
def edges(spark):
    """Documents of odd kinds, with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(EDGES, DOCUMENT)
    names = ("size", "shard", "slot", "fp", "mark", "ids", "score", "kept_text", "n_words", "lang_pred", "word")
    return frame.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], DOCUMENT)
