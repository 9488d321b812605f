import zlib
from collections import defaultdict

from starqa.llm.sharding import byte_shards


def check(rows, given, shards=8):
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in given)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in rows)
    assert got == want
    by_shard = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        by_shard[r.shard].append(r)
    last = None
    for shard in sorted(by_shard):
        own = sorted(by_shard[shard], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        ids = [-1 if r.doc_id is None else r.doc_id for r in own]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
    return {s: sum(r["size"] for r in own) for s, own in by_shard.items()}


def test_shares_are_equal_but_for_a_document_at_either_end(spark):
    given = [(i, "x" * (i * 37 % 400)) for i in range(3000)] + [(5000 + i, "copy") for i in range(1000)]
    sizes = check(byte_shards(spark.createDataFrame(given, "doc_id long, text string")).collect(), given)
    total = sum(sizes.values())
    assert len(sizes) == 8 and all(abs(n - total / 8) <= 400 for n in sizes.values())


def test_odd_rows_and_one_repeated_row(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    check(byte_shards(edges).collect(), rows)
    same = [(1, "same")] * 400
    sizes = check(byte_shards(spark.createDataFrame(same, "doc_id long, text string")).collect(), same)
    assert set(sizes.values()) == {250}
    assert byte_shards(nothing).collect() == []
