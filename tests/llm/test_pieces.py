import random
from functools import lru_cache

import pytest
import sentencepiece
from pyspark.sql import functions as F

from starqa.llm import pieces
from starqa.llm.vocabulary import default_path, load_pieces


@pytest.fixture(scope="module")
def vocabulary():
    return load_pieces()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=default_path())


def texts():
    rng = random.Random(7)
    words = "the of and Antonio über naïve señor thn thererer ing ation 12 345 x,y (z) \U0001f600 中文 ﬁ don't    \n \t\t end.".split(" ")
    return ["", "a", " ", "  a  b ", "\n", *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(300))]


def best_score(text, vocabulary):
    """The best score of all ways to cut a text, by trying each."""

    @lru_cache(None)
    def rest(i):
        if i == len(text):
            return 0.0
        ways = [vocabulary.scores[text[i:j]] + rest(j) for j in range(i + 1, len(text) + 1) if text[i:j] in vocabulary.scores]
        return max(ways) if text[i] in vocabulary.scores else max([*ways, vocabulary.unknown_score + rest(i + 1)])

    return rest(0)


def test_no_segmentation_scores_better(vocabulary, library):
    encoder = pieces.Encoder(vocabulary)
    of_byte = {i for i in range(library.vocab_size()) if library.is_byte(i)}
    for text in {w for t in texts() for w in t.split()} | {"thererering", "  two", "a  b c"}:
        ids = memoryview(encoder.encode(text)).cast("i").tolist()
        strange = sum(1 for c in text if c not in vocabulary.ids and c != " ")
        score = sum(library.get_score(i) for i in ids if i not in of_byte) + strange * vocabulary.unknown_score
        assert score == best_score("▁" + text.replace(" ", "▁"), vocabulary), text


def test_the_library_decodes_the_same(vocabulary, library):
    encoder = pieces.Encoder(vocabulary)
    for text in texts():
        assert library.decode(memoryview(encoder.encode(text)).cast("i").tolist()) == text


def test_round_trip(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    for text in [*texts(), "▁", "a▁▁b ▁", "\x00\x1f", "é", "x" * 5000, "ab" * 3000 + " ▁" * 50, "�"]:
        assert pieces.decode(memoryview(encoder.encode(text)).cast("i").tolist(), vocabulary.raw) == text


def test_memory_is_bounded_and_streaming_changes_nothing(vocabulary, monkeypatch):
    """Long stretches without a cut: the same as one search over the whole."""
    rng = random.Random(1)
    text = "".join(rng.choice(["the", "er", "ing", "a", "é", "☃", "ion"]) for _ in range(3000))
    encoder = pieces.Encoder(vocabulary)
    most = 0
    commit = pieces.Encoder._commit

    def watched(self, text, best, start, end, out):
        nonlocal most
        most = max(most, len(best))
        commit(self, text, best, start, end, out)

    monkeypatch.setattr(pieces.Encoder, "_commit", watched)
    ids = memoryview(encoder.encode(text)).cast("i").tolist()
    assert most < 12 * vocabulary.longest
    # One search, back from the end.
    whole = "▁" + text
    best = [(0.0, 0, [])] + [None] * len(whole)
    for i in range(len(whole)):
        for j in range(i + 1, min(len(whole), i + vocabulary.longest) + 1):
            p = whole[i:j]
            known = p in vocabulary.ids
            if not known and j > i + 1:
                continue
            new = [vocabulary.ids[p]] if known else [vocabulary.bytes_[b] for b in p.encode()]
            score = best[i][0] + (vocabulary.scores[p] if known else vocabulary.unknown_score)
            if best[j] is None or score > best[j][0]:
                best[j] = (score, i, new)
    path, j = [], len(whole)
    while j:
        path.append(best[j][2])
        j = best[j][1]
    assert ids == [x for part in reversed(path) for x in part]


def test_frames(spark, edges, nothing, vocabulary):
    encoded = pieces.encode_texts(edges, vocabulary)
    assert encoded.columns == [*edges.columns, "ids_"]
    back = pieces.decode_ids(encoded, vocabulary, ids="ids_")
    assert back.where(~F.col("decoded").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert back.count() == edges.count()
    assert pieces.encode_texts(nothing).collect() == []
