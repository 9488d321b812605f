"""The operators of this package as queries over the given tables: ``name -> (spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starqa.llm import chat, hmm, langid, mixing, mtree, phrases, pieces, quality, repeats, secrets, sharding, simhash, trie
from starqa.llm.common import is_training, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: What the added conversation of op4 says in both turns.
CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@query
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text again (null texts count as empty)."""
    encoded = pieces.encode_texts(table(spark, folder, "documents").select("doc_id", "text"))
    back = pieces.decode_ids(encoded)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_quality_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return quality.rate(table(spark, folder, "documents"))


@query
def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    chats = chat.format_chats(given.unionByName(added))
    read = chats.select(
        "conv_id", "valid", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


@query
def op5_mtree_search(spark: SparkSession, folder: str) -> DataFrame:
    return mtree.top_inner_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.identify(documents, langid.held_out_third())
    return found.select("doc_id", langid.held_out_third().alias("held_out"), "lang_pred", "score")


@query
def op7_hmm_score(spark: SparkSession, folder: str) -> DataFrame:
    held_out = ~is_training(F.col("doc_id"), 7, 2)
    scored = hmm.score(table(spark, folder, "documents"), held_out, rounds=None)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents"))


@query
def op9_byte_shards(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, folder, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_simhash_classes(spark: SparkSession, folder: str) -> DataFrame:
    classes = simhash.near_duplicate_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.numbered_turns(table(spark, folder, "conversations"))
    return trie.prefix_trie(*trie.with_shared_heads(turns))


@query
def op13_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, folder, "documents"))
    of = lambda kind: F.filter("found", lambda s: s["kind"] == kind)
    base = F.filter("found", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.col("found")).alias("spans"),
        F.size(of("random")).cast("long").alias("n_random"),
    )
