import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from starqa.llm import trie

TURN = "conv_id long, turn long, role string, text string"


def rebuilt_by_hand(rows):
    given = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            given[c].append((turn is not None, turn or 0, role or "", text or ""))
    given = {c: [t[2:] for t in sorted(ts)] for c, ts in given.items()}
    out = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = given.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    return out


def by_hand(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = set()
    for path, of in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = sum(len(p) == len(path) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(of) if len(convs[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        rows.add((min(of), len(path), parent, len(of), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def found(spark, rows):
    frame = spark.createDataFrame(rows, TURN).withColumns({n: F.lit(1) for n in ("pos", "depth", "k1", "part", "at")})
    return sorted(map(tuple, trie.prefix_trie(*trie.with_shared_heads(trie.numbered_turns(frame))).collect()))


def conversations(rng, ids, most, choices):
    rows = []
    for c in ids:
        for turn in range(rng.randint(1, most)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], " ".join(rng.choice("abc") for _ in range(rng.randint(0, choices)))))
    return rows


@pytest.fixture
def small_shards(monkeypatch):
    monkeypatch.setattr(trie, "BLOCK_BITS", 3)
    monkeypatch.setattr(trie, "BAND", 4)


@pytest.mark.parametrize("seed", range(3))
def test_against_the_plain_version(spark, seed):
    rng = random.Random(seed)
    rows = conversations(rng, [*range(70), 200, 345, -3, 10**12], 6, 1)
    assert found(spark, rows) == sorted(by_hand(rebuilt_by_hand(rows)), key=lambda r: (r[0], r[1]))


def test_long_and_equal_conversations_over_many_shards(spark, small_shards):
    """Bands and blocks meet as one trie: a conversation far longer than a band, and copies of it."""
    rng = random.Random(4)
    long = [("user", str(rng.random())) for _ in range(30)]
    rows = [(c, t, *long[t]) for c in [*range(0, 60, 5), 21, 22] for t in range(30 - c % 7)]
    rows += conversations(rng, range(100, 140), 9, 1)
    assert found(spark, rows) == sorted(by_hand(rebuilt_by_hand(rows)), key=lambda r: (r[0], r[1]))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (None, None, None, None), (5, None, None, None), (5, 1, None, None), (5, 1, "user", "a b"), (5, 1, "user", "a b"),
            (7, 0, "user", "word " * 20_000), (27, 0, "user", "word " * 20_000), (0, 3, "é", "\x00"), (1, None, "", "")]
    rng = random.Random(1)
    rng.shuffle(rows)
    got = found(spark, rows)
    assert [r[:6] + r[7:] for r in got] == [r[:6] + r[7:] for r in sorted(by_hand(rebuilt_by_hand(rows)), key=lambda r: (r[0], r[1]))]
    assert {r[6] for r in got} == {r[6] for r in by_hand(rebuilt_by_hand(rows))}
    assert found(spark, [(None, 0, "user", "x")]) == []
    assert trie.prefix_trie(*trie.with_shared_heads(trie.numbered_turns(spark.createDataFrame([], TURN)))).collect() == []


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A conversation's turns lie in several partitions; no shard has more than its block and band."""
    spark.conf.set("spark.sql.shuffle.partitions", 5)
    sizes = []
    search = trie._search
    rows = [(20, t, "user", f"t {t % 7}") for t in range(3000)] + [(c, 0, "user", "t 0") for c in range(21, 40)]
    frame = trie.numbered_turns(spark.createDataFrame(rows, TURN))
    assert sorted(r.pos for r in frame.where("conv_id = 20").collect()) == list(range(1, 3001))
    convs, turns = trie.with_shared_heads(frame)
    nodes = trie.prefix_trie(convs, turns)
    deep = nodes.where("conv_id = 20").agg(F.max("depth"), F.count("*"), F.min("n_leaves")).first()
    assert tuple(deep)[:2] == (3000, 3001) and deep[2] == 1
    root = nodes.where("depth = 0").first()
    assert root.n_convs == 20 and root.saved_tokens == sum(
        (r.n_convs - 1) * 2 for r in nodes.where("depth > 0").collect()
    )
