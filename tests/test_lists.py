"""Which texts the queries of parse_list read."""

from checks.queries import QUERIES
from conftest import SMALL


def test_event_texts_and_json_lists_are_parsed(spark):
    events = {r.event_id: r for r in spark.read.parquet(f"{SMALL}/events.parquet").collect()}
    got = {}
    for r in sorted(QUERIES["x3b_parse_list_json"](spark, SMALL).collect(), key=lambda r: r.pos):
        got.setdefault((r.kind, r.id), []).append(r.item)
    for i, e in events.items():
        assert got["event", i] == [e.props]
        assert got["object", i] == [e.event_type, str(e.user_id), "None", "True", "7", "a, b"]
        assert got["array", i] == [str(i), e.event_type, "", str(e.user_id), "False"]  # a list in brackets reads as a note
