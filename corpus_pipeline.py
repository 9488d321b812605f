"""A corpus made ready for training: five stages, each over all that the one before kept.

Every stage gives no rows for an empty table, reads whole texts of any length and
keeps further columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starqa.llm import langid, mixing, pieces, repeats, simhash
from starqa.llm.common import fresh, table
from starqa.sources.storage import stored

#: Texts whose language is less likely than this against all others are turned away.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text has a letter and fits one language at LEAST_SCORE or more.

    Null and empty texts go.  Each row is judged by itself, so repeated rows stay
    or go together; the first language by name wins a tie.  Where no row has both
    a text and a language nothing can be learned and all go.
    """
    pred, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = langid.identify(docs, langid.held_out_third())
    return found.where((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class (op10's shingles and bits), that with the smallest id.

    Null and empty texts share one class; a null id comes after all others; of
    repeated rows one stays.
    """
    return simhash.one_of_each_class(docs, shingle=simhash.SHINGLE)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur more than once.

    Texts of which nothing goes, null and empty ones among them, stay as they
    are; repeated rows lose their words, as each repeats the other.
    """
    kept, removed = fresh(docs, "kept_text"), fresh(docs, "n_removed")
    done = repeats.remove_repeats(docs, layout=True)
    changed = F.col(removed) > 0
    new = {"text": F.when(changed, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix draws, as documents: a row for each document and pass.

    Texts without words cannot be drawn and go; null sources are one source;
    repeated rows are drawn each for itself.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their SentencePiece ids, none for a null or empty text."""
    return pieces.encode_texts(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Language models, fingerprints and pieces are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None
