"""Mixing sources to target weights by drawing fixed-length blocks of words.

Everything here is DataFrame code.  The words of a source, document after
document, are cut into blocks.  A source draws whole passes over its blocks and
part of a last pass, each in a pseudorandom order; the draws of all sources are
dealt over output shards by another such order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starqa.llm.common import WORD, fresh
from starqa.sources.storage import stored

#: Words of a block, blocks of an output shard, documents of a pack (about).
BLOCK, SHARD, PACK = 64, 4096, 1024
#: Weights of sources in order of their names, repeating; share of all words to take; passes at most.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Rounds of a permutation; its constants come from this prime and seed.
ROUNDS, PRIME, SEED = 20, 2147483647, 42


def round_constants(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round, by a linear congruence."""
    state, out = seed % PRIME, []
    for _ in range(3 * ROUNDS):
        state = (state * 48271 + 12345) % PRIME
        out.append(state)
    return list(zip(out[::3], out[1::3], out[2::3], strict=True))


def permuted(rows: DataFrame, index: str, size: str, seed: int = SEED) -> DataFrame:
    """``index`` replaced by its image under a permutation of 0 .. ``size`` - 1.

    Swap-or-not shuffle: in each round x and (key - x) mod size are a pair, and
    a bit computed from the larger one says whether to swap; whatever the bits
    are, that is one to one, for any size, so no cycle is walked.
    """
    n = F.col(size)
    rounds = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) for k, v in zip("abc", r, strict=True))) for r in round_constants(seed)))

    def swap_or_not(x: Column, r: Column) -> Column:
        pair = F.pmod(r["a"] - x, n)
        mixed = (F.greatest(x, pair) % PRIME * r["b"] + r["c"]) % PRIME
        bit = F.shiftright((mixed * mixed + r["a"]) % PRIME, 7).bitwiseAND(F.lit(1))
        return F.when(bit == 1, pair).otherwise(x)

    return rows.withColumn(index, F.aggregate(rounds, F.col(index), swap_or_not))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def identity(doc_id: str, source: str, text: str) -> tuple[Column, Column]:
    """Two hashes that are equal for rows of equal id, source and text."""
    return F.xxhash64(doc_id, source, text), F.hash(doc_id, source, text)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """``source``, ``source_size``, ``target``: words to take from each source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words by weight.  A target stops at PASSES times the size;
    what is above is shared again by weight among the rest.  In closed form:
    with sources ordered by size over weight, those that stop are the first
    few, up to where the rest's share per weight no longer exceeds a bound.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    listed = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
        .withColumn("most", (F.col("source_size") * PASSES).cast("double"))
    )
    tight = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    upto = tight.rowsBetween(Window.unboundedPreceding, -1)
    bounded = (
        listed.withColumn("most_before", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("rate", (F.col("wanted") - F.col("most_before")) / F.col("weight_left"))
        .withColumn("stops", F.col("weight") * F.col("rate") >= F.col("most"))
    )
    rate = F.min(F.when(~F.col("stops"), F.col("place"))).over(everything)
    return (
        bounded.withColumn("place", F.row_number().over(tight))
        .withColumn("first_free", rate)
        .withColumn("free_rate", F.max(F.when(F.col("place") == F.col("first_free"), F.col("rate"))).over(everything))
        .select(
            "source", "source_size",
            F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.col("free_rate")).alias("target"),
        )
    )


def _placed(documents: DataFrame, names: dict[str, str]) -> DataFrame:
    """Every document with its size and where its words start in its source.

    Documents are dealt to packs by hash of id and text; a source's words are
    its packs in turn.  Sums run within packs, and over packs of a source.
    """
    packs = max(1, -(-documents.count() // PACK))
    slim = stored(
        documents.select(
            F.col(names["doc_id"]).alias("doc_id"),
            F.col(names["source"]).alias("source"),
            word_count(F.col(names["text"])).alias("size"),
            *(c.alias(n) for c, n in zip(identity(names["doc_id"], names["source"], names["text"]), ("mark", "mark2"), strict=True)),
        ).withColumn("pack", F.pmod(F.hash("mark"), F.lit(packs))),
        "sizes",
    )
    inside = Window.partitionBy("source", "pack").orderBy("doc_id", "mark", "mark2")
    equal = Window.partitionBy("source", "pack", "doc_id", "mark", "mark2")
    before = Window.partitionBy("source").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.groupBy("source", "pack").agg(F.sum("size").alias("pack_size"))
    starts = starts.withColumn("pack_start", F.coalesce(F.sum("pack_size").over(before), F.lit(0))).drop("pack_size")
    running = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    rows = slim.withColumn("nth", F.row_number().over(inside)).withColumn("inner_start", running)
    rows = rows.withColumn("equal_no", F.col("nth") - F.min("nth").over(equal) + 1)
    same = rows["source"].eqNullSafe(starts["source"]) & (rows["pack"] == starts["pack"])
    return rows.join(starts, same).select(
        rows["doc_id"], rows["source"], rows["pack"], "nth", "equal_no", "size", "mark", "mark2", F.expr("pack_start + inner_start").alias("start")
    )


def draw_blocks(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """One row per drawn block: shard, place, source, block_no, pass_no.

    ``sources`` has source, source_size, target.  A source with n blocks draws
    round(target * n / size) of them: the i-th draw is block perm(i mod n) of
    pass i div n.  A permutation of all draws gives each its shard and place.
    So the counts of a shard are multinomial draws given what each source draws
    in total; draws without that condition would pass the bound of two copies.
    """
    before = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    drawing = (
        sources.where("source_size > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("draws", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
        .withColumn("draw_start", F.coalesce(F.sum("draws").over(before), F.lit(0)))
        .withColumn("all_draws", F.sum("draws").over(Window.partitionBy()))
        .where("draws > 0")
    )
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = drawing.withColumn("run", F.explode(F.expr(f"sequence(0, (draws - 1) div {shard})")))
    one_by_one = runs.repartition(parts, "source", "run").withColumn(
        "i", F.explode(F.expr(f"sequence(run * {shard}, least(draws, (run + 1) * {shard}) - 1)"))
    )
    slots = one_by_one.select(
        "source", "blocks", "all_draws",
        F.expr("i % blocks").alias("block_no"), F.expr("i div blocks").alias("pass_no"),
        F.expr("draw_start + i").alias("slot"),
    )
    slots = permuted(permuted(slots, "block_no", "blocks", seed), "slot", "all_draws", seed + 1)
    return slots.select(
        F.expr(f"slot div {shard}").alias("shard"), F.expr(f"slot % {shard}").alias("place"),
        "source", "block_no", "pass_no",
    )


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets, and pieces of documents by drawn block.

    Pieces: pack, nth, equal_no, doc_id, source, mark, mark2, size, and for each drawn block that
    holds words of the document shard, place, pass_no, first_word (from 0) and
    n_words.  A document of which no block is drawn has one piece with nulls.
    Null texts have no words, null sources are a source of their own, repeated
    rows are documents of their own; other columns are not used.
    """
    names = {"doc_id": doc_id, "text": text, "source": source}
    rows = stored(_placed(documents, names), "placed")
    sources = stored(source_targets(rows, weights, share), "sources")
    draws = draw_blocks(sources, block)
    whole = F.explode(
        F.expr(f"if(size > 0, sequence(start div {block}, (start + size - 1) div {block}), array(-1L))")
    )
    pieces = (
        rows.withColumn("block_no", whole)
        .withColumn("first_word", F.greatest(F.lit(0), F.expr(f"block_no * {block} - start")))
        .withColumn("n_words", F.expr(f"least(size, (block_no + 1) * {block} - start) - first_word"))
    )
    same = pieces["source"].eqNullSafe(draws["source"]) & (pieces["block_no"] == draws["block_no"])
    # Sizes after an explode are guessed far too small, so neither side may be broadcast.
    return sources, pieces.join(draws.hint("merge"), same, "left").select(
        "pack", "nth", "equal_no", "doc_id", pieces["source"], "mark", "mark2", "size", "shard", "place", "pass_no",
        F.when(F.col("shard").isNotNull(), F.col("first_word")).alias("first_word"),
        F.when(F.col("shard").isNotNull(), F.col("n_words")).alias("n_words"),
    )


def mixed_sizes(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    sources, pieces = mix(documents, **options)
    taken = pieces.groupBy("pack", "nth", "doc_id", "source", "size").agg(
        F.coalesce(F.sum("n_words"), F.lit(0)).alias("taken")
    )
    return taken.join(sources, taken["source"].eqNullSafe(sources["source"])).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The drawn words as documents: a row per document and pass, with the columns given.

    Where a pass holds all words of a document, its text stays as it is; else
    the row has the drawn words in order, each with the white space before it.
    Documents without words cannot be drawn and go.  ``n_chars``, where there is
    such a column, is counted anew; other columns are kept.  Rows that share id,
    source and text are drawn each for itself, with the other columns of any of
    them: their text is kept once and meets what is drawn of all, row by row.
    """
    text = options.get("text", "text")
    keys = identity(options.get("doc_id", "doc_id"), options.get("source", "source"), text)
    _, pieces = mix(documents, **options)
    run = F.struct("first_word", "n_words")
    # The runs of one document in one pass.
    passes = (
        pieces.where("n_words > 0")
        .groupBy(F.col("mark").alias("_mark"), F.col("mark2").alias("_mark2"), "equal_no", "pass_no")
        .agg(F.sort_array(F.collect_list(run)).alias("runs"), F.sum("n_words").alias("taken"), F.first("size").alias("size"))
    )
    drawn = passes.select("_mark", "_mark2", F.struct("runs", "taken", "size").alias("_drawn"))
    row, mark, mark2 = (fresh(documents, n) for n in ("_row", "_m", "_n"))
    once = (
        documents.select(F.struct(*documents.columns).alias(row), keys[0].alias(mark), keys[1].alias(mark2))
        .groupBy(mark, mark2).agg(F.first(row).alias(row))
    )
    met = once.join(drawn.hint("merge"), (F.col(mark) == F.col("_mark")) & (F.col(mark2) == F.col("_mark2")))
    tokens = F.regexp_extract_all(F.col(row)[text], F.lit(r"[\x20\x09-\x0D]*" + WORD), 0)
    with_tokens = met.withColumn("_tokens", F.when(F.col("_drawn.taken") != F.col("_drawn.size"), tokens))
    some = F.flatten(
        F.transform(F.col("_drawn.runs"), lambda r: F.slice("_tokens", (r["first_word"] + 1).cast("int"), r["n_words"].cast("int")))
    )
    new_text = F.when(F.col("_drawn.taken") == F.col("_drawn.size"), F.col(row)[text]).otherwise(F.array_join(some, ""))
    out = with_tokens.select(row, new_text.alias("_text"))
    column = {text: F.col("_text")}
    if "n_chars" in documents.columns:
        column["n_chars"] = F.length("_text").cast(documents.schema["n_chars"].dataType)
    return out.select(*(column.get(c, F.col(row)[c]).alias(c) for c in documents.columns))
