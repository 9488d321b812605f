"""Scoring of answers: hand-made cases, and ranked answers by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from starqa.functions.names import normalize_all
from starqa.operators.grading import mentions, score_answers

TASKS = (
    "task_id string, template_id string, answer_type string, k int, value double, "
    "abs_tol double, rel_tol double, n_truth int"
)
TRUTH = "task_id string, lo bigint, hi bigint, key string, order_key string, spellings array<string>"


class Truths:
    """Collects tasks and truths, then grades answers against them."""

    def __init__(self):
        self.tasks, self.truth, self.universe, self.answers = [], [], [], []

    def task(self, kind, groups=(), k=0, value=None, tol=(0.01, 1e-3), others=()):
        name = f"t{len(self.tasks)}"
        members = [m for group in groups for m in group]
        self.tasks.append((name, f"u{name}", kind, k, value, *tol, len(members)))
        start = order = 0
        for group in groups:
            for member in group:
                key, *spellings = member if isinstance(member, tuple) else (member, member)
                end = start + len(group) - 1
                self.truth.append((name, start, end, key, f"{order:06d}", [key, *spellings]))
                self.universe.append((f"u{name}", key, [key, *spellings]))
                order += 1
            start += len(group)
        self.universe += [(f"u{name}", other, [other]) for other in others]
        return name

    def answer(self, task, text):
        self.answers.append((len(self.answers), task, text))

    def scores(self, spark):
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        aliases = normalize_all(F.col("spellings"))
        truth = frame(self.truth, TRUTH).withColumn("aliases", aliases)
        universe = frame(self.universe, "template_id string, key string, spellings array<string>")
        graded = score_answers(
            frame(self.answers, "answer_id int, task_id string, answer string"),
            frame(self.tasks, TASKS),
            truth,
            universe.withColumn("aliases", aliases),
        )
        return [r.score for r in graded.orderBy("answer_id").collect()]


def graded(spark, cases):
    """Scores of (task arguments, text) cases, graded in one job."""
    truths = Truths()
    for arguments, text in cases:
        truths.answer(truths.task(**arguments), text)
    return truths.scores(spark)


def ranked(groups, k):
    return {"kind": "ranked_list", "groups": groups, "k": k}


ABC = ranked([["Alice"], ["Bob"], ["Carla"]], 3)
SPILL = ranked([["Alice"], ["Bob"], ["C", "D", "E", "F", "G", "H"]], 3)
IDS = ranked([[("42", "Alice Smith")], [("7", "Bob Jones")]], 2)
TIED = ranked([["Alice", "Bob", "Carla"]], 3)
ALL = {"kind": "entity_set", "groups": [["Alice", "Bob", "Carla"]]}
TWO = {"kind": "entity_set", "groups": [["Alice", "Bob"]]}
ROCK = {"kind": "categorical", "groups": [["Rock"]], "k": 1, "others": ["Latin", "Jazz", "Heavy Metal"]}
BOTH = {"kind": "categorical", "groups": [["Rock", "Latin"]], "k": 1, "others": ["Jazz"]}
MONEY = {"kind": "numeric", "value": 481.45}
COUNT = {"kind": "numeric", "value": 5.0, "tol": (0.0, 0.0)}
ZERO = {"kind": "numeric", "value": 0.0}
DUMP = "\n".join(["Alice", "Bob"] + [f"Filler {i}" for i in range(48)])

CASES = [
    (MONEY, "481.45", 1),
    (MONEY, "481.4500001", 1),
    (MONEY, "$481.45", 1),
    (MONEY, "481.93", 1),
    (MONEY, "481.99", 0),
    (MONEY, "nonsense", 0),
    (MONEY, "NaN", 0),
    (COUNT, "5", 1),
    (COUNT, "6", 0),
    (ZERO, "0.01", 1),
    (ZERO, "0.02", 0),
    (ABC, "1. Alice\n2. Bob\n3. Carla", 1),
    (ABC, "1. Carla\n2. Bob\n3. Alice", 1 / 3),
    (TIED, "1. Carla\n2. Alice\n3. Bob", 1),
    (TIED, "Bob, Alice, Carla", 1),
    (SPILL, "1. Alice\n2. Bob\n3. G", 1),
    (SPILL, "1. G\n2. Alice\n3. Bob", 0),
    (ranked([["Alice"], ["Bob"], ["Carla"], ["Dan"]], 4), "Alice, Bob, Zed, Zoe", 0.5),
    (ABC, "Alice\nAlice\nAlice", 1 / 3),
    (ABC, "Zed\nZoe\nZack\nAlice\nBob\nCarla", 0),
    (IDS, "1. 42\n2. 7", 1),
    (IDS, "1. ALICE  smith.\n2. Bob Jones", 1),
    (ranked([["Alice"], ["Bob"]], 0), "Alice, Bob", 1),
    (ranked([], 0), "Alice", 0),
    (ABC, '["", "Bob", "Carla"]', 0),
    (ABC, '["(x)", "Bob", "Carla"]', 2 / 3),
    (ALL, "Carla\nAlice\nBob", 1),
    (TWO, DUMP, 2 / 50),
    (ALL, "Alice\nBob", 2 / 3),
    (ALL, "Alice\nZed", 1 / 4),
    (TWO, "Alice\nalice.\nALICE", 1 / 2),
    (TWO, "Alice\nZed\nzed!", 1 / 3),
    ({"kind": "entity_set", "groups": []}, "", 1),
    ({"kind": "entity_set", "groups": []}, "Alice", 0),
    (ROCK, "Rock", 1),
    (ROCK, "The top genre was Rock.", 1),
    (ROCK, "The top genre was heavy metal.", 0),
    (ROCK, "Latin", 0),
    (ROCK, "Rock, Latin", 0),
    (ROCK, "Rock, Rock", 1),
    (ROCK, "It is either Rock or Latin or Jazz.", 0),
    (ROCK, "Rockabilly it is", 0),
    (BOTH, "Rock", 1),
    (BOTH, "Latin", 1),
    (BOTH, "Latin, Rock", 1),
    (BOTH, "It was Latin, surely", 1),
    (BOTH, "It was Latin or Rock", 0),
    (BOTH, "Jazz", 0),
] + [(task, text, 0) for task in (ABC, ALL, ROCK, MONEY) for text in ("", "   ", None)]


def test_cases(spark):
    found = graded(spark, [(task, text) for task, text, _ in CASES])
    wrong = [
        (task, text, score, got)
        for (task, text, score), got in zip(CASES, found)
        if got != pytest.approx(score)
    ]
    assert not wrong


def by_hand(entities, items, k):
    """Ranked hits where one spelling may name several entities.

    Every item goes to the best placed entity it names that is still free; it
    counts, and uses the entity up, if its position lies in that entity's band.
    """
    free = list(entities)
    hits = 0
    for position, item in enumerate(items[:k]):
        named = next((e for e in free if item in e["names"]), None)
        if named is not None and named["lo"] <= position <= named["hi"]:
            hits += 1
            free.remove(named)
    return hits / k


def test_shared_spellings_by_brute_force(spark):
    rng = random.Random(11)
    truths, expected = Truths(), []
    for _ in range(300):
        names = iter(f"n{i}" for i in itertools.count())
        groups = [
            [(next(names), rng.choice("xyz")) for _ in range(rng.randint(1, 3))]
            for _ in range(rng.randint(1, 4))
        ]
        size = sum(map(len, groups))
        k = rng.randint(1, size)
        task = truths.task("ranked_list", groups, k)
        entities, start = [], 0
        for group in groups:
            for name, spelling in group:
                entities.append({"names": {name, spelling}, "lo": start, "hi": start + len(group) - 1})
            start += len(group)
        pool = [n for e in entities for n in e["names"]] + ["nobody"]
        items = [rng.choice(pool) for _ in range(rng.randint(1, 6))]
        truths.answer(task, "\n".join(items) + "\n" * (len(items) == 1))
        expected.append(by_hand(entities, items, k))
    assert truths.scores(spark) == pytest.approx(expected)


def test_many_entities_behind_one_spelling(spark):
    """More namesakes than positions: only the best placed can be reached."""
    truths = Truths()
    task = truths.task("ranked_list", [[(f"n{i}", "smith") for i in range(200)]], 3)
    for text, _ in (answers := [("smith\nsmith\nsmith", 1.0), ("smith\nn0\nn199", 2 / 3), ("n0\nsmith\nn1", 2 / 3)]):
        truths.answer(task, text)
    assert truths.scores(spark) == pytest.approx([score for _, score in answers])


def test_answer_without_task_scores_zero(spark):
    truths = Truths()
    truths.task(**ABC)
    truths.answer("unknown", "Alice")
    assert truths.scores(spark) == [0.0]


def test_mentions(spark):
    texts = spark.createDataFrame([(1, "Rock, and heavy-metal!"), (2, "rocky"), (3, None)], "id int, t string")
    names = spark.createDataFrame(
        [("Rock", ["rock"]), ("Metal", ["metal", "heavy metal"]), ("Jazz", ["jazz"])],
        "key string, aliases array<string>",
    )
    found = {(r.id, r.key) for r in mentions(texts, "id", "t", names).collect()}
    assert found == {(1, "Rock"), (1, "Metal")}


def test_mentions_of_several_words(spark):
    """Only words that follow one another in one text count; texts of one id are not mixed."""
    texts = spark.createDataFrame(
        [(1, "new york, New York city"), (2, "new old york"), (3, "new"), (3, "york city"), (4, "a b a b a c"), (4, "a b a b a c"),
         (None, "new york"), (5, ""), (6, "york new " * 5000 + "york city")],
        "id int, t string",
    )
    names = spark.createDataFrame(
        [("ny", ["new york"]), ("nyc", ["new york city", "nyc"]), ("abc", ["a b a c"]), ("aba", ["a b a b a"]), ("none", []), ("blank", [""])],
        "key string, aliases array<string>",
    )
    found = {(r.id, r.key) for r in mentions(texts, "id", "t", names).collect()}
    assert found == {(1, "ny"), (1, "nyc"), (4, "abc"), (4, "aba"), (None, "ny"), (6, "ny"), (6, "nyc")}


def test_mentions_of_long_names_and_long_texts(spark):
    """Names of more words than are looked up at once, at the edges of a text's rows, and pieces that do not follow one another."""
    words = [f"w{i % 700}" for i in range(3000)]
    run = lambda a, n: " ".join(words[a : a + n])
    broken = run(100, 8) + " x " + run(108, 12)
    texts = spark.createDataFrame([(1, run(0, 3000)), (1, run(0, 3000)), (2, broken), (3, run(100, 19)), (4, "Ünder " + run(5, 30))], "id int, t string")
    spans = [(100, 20), (1020, 8), (1017, 30), (1023, 2), (2990, 10), (2, 400), (5, 16)]
    names = spark.createDataFrame([(f"{a}+{n}", [run(a, n)]) for a, n in spans] + [("under", ["under w5"]), ("no", [run(100, 8) + " " + run(107, 8)])], "key string, aliases array<string>")
    found = {(r.id, r.key) for r in mentions(texts, "id", "t", names).collect()}
    rows = {1: run(0, 3000), 2: broken, 3: run(100, 19), 4: "under " + run(5, 30)}
    wanted = {(i, r.key) for i, t in rows.items() for r in names.collect() if f" {r.aliases[0]} " in f" {t} "}
    assert found == wanted and (1, "1017+30") in found and (2, "100+20") not in found


def test_mentions_do_not_send_texts(spark):
    """Names are broadcast; only what was found is shuffled."""
    texts = spark.createDataFrame([(1, "new york city"), (2, "york")], "id int, t string")
    names = spark.createDataFrame([("a", ["new york"]), ("b", ["york"])], "key string, aliases array<string>")
    found = mentions(texts, "id", "t", names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
