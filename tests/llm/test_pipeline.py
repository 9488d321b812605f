"""The pipeline's stages against a plain version of each, over the small tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import SMALL
from starqa.llm import mixing, simhash
from llm.test_repeats import by_hand
from llm.test_simhash import classes, fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:5]) and len(corpus_pipeline.STAGES) == 5


def test_language_stage_keeps_texts_with_letters(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    given = {r.doc_id for r in stages[0].collect() if any(c.isalpha() for c in r.text or "")}
    assert kept <= given and len(kept) > 0.98 * len(given)


def test_one_document_of_each_class(stages):
    rows = sorted(((r.doc_id, r.text) for r in stages[1].collect()))
    of = classes([fingerprint(t) for _, t in rows])
    assert {r.doc_id for r in stages[2].collect()} == {rows[i][0] for i in set(of)}


def test_near_duplicates_meet_without_a_broadcast(spark, monkeypatch):
    """However few the documents: each fingerprint has about 71 replicas, which Spark does not foresee."""
    plans = {}

    def stored(df, name, write=simhash.stored):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "stored", stored)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x")], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert "SortMergeJoin" in plans["links"] and "Broadcast" not in plans["links"]


def test_repeated_passages_go(stages):
    rows = stages[2].collect()
    wanted = dict(zip((r.doc_id for r in rows), by_hand([r.text for r in rows], 35)))
    for r in stages[3].collect():
        n, gone, kept = wanted[r.doc_id]
        assert r.text.split() == kept.split() and r.n_chars == len(r.text)
    assert any(gone for _, gone, _ in wanted.values())


def test_mix_and_ids(stages, spark):
    sizes = {r.doc_id: r.taken for r in mixing.mixed_sizes(stages[3]).collect()}
    got = Counter()
    for r in stages[4].collect():
        got[r.doc_id] += len(r.text.encode().split())
    assert got == Counter({i: n for i, n in sizes.items() if n})
    last = stages[5]
    assert last.count() == stages[4].count() and last.where(F.size("ids") == 0).count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SMALL)
    both = [x.groupBy("doc_id", "text", "ids").count() for x in (got, stages[5])]
    assert both[0].exceptAll(both[1]).count() == both[1].exceptAll(both[0]).count() == 0


@pytest.mark.parametrize("given", ["edges", "nothing"])
def test_odd_tables(spark, given, request, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, no rows."""
    docs = request.getfixturevalue(given)
    names, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out.append(docs.collect())
        assert docs.columns[: len(names)] == names
    if given == "nothing":
        assert not any(out)
        return
    languages, classes, passages, mixed, _ = out
    assert all(r.text and any(c.isalpha() for c in r.text) for r in languages)
    assert len({(r.doc_id, r.text) for r in classes}) == len(classes) <= len(languages)
    assert [r.doc_id for r in classes] and {r.doc_id for r in passages} == {r.doc_id for r in classes}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in passages}
