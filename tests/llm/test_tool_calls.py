import json
import random

from storyloom.llm import tool_calls as t

CALLS = "conv string, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv string, call_id string, turn long, content string"


def plain_levels(needs):
    level = {}
    while True:
        new = {c: 1 + max((level[d] for d in ds), default=-1) for c, ds in needs.items() if c not in level and all(d in level for d in ds)}
        if not new:
            return level
        level |= new


def link(spark, calls, results=()):
    rows = t.link(spark.createDataFrame(list(calls), CALLS), spark.createDataFrame(list(results), RESULTS), t.SCHEMAS).collect()
    # Rows have no order; a repeated identifier's earliest call stands for it.
    return {(r.conv, r.call_id): r for r in sorted(rows, key=lambda r: "duplicate" not in r.errors)}


def test_levels_of_random_graphs_with_chains_and_circles(spark):
    rng = random.Random(3)
    needs = {f"c{k}": [f"c{k - 1}"] if k else [] for k in range(70)}  # a long chain
    for k in range(40):
        needs[f"d{k}"] = rng.sample([f"d{j}" for j in range(k)], min(k, rng.randint(0, 3))) + rng.sample([f"c{j}" for j in range(70)], rng.randint(0, 1))
    needs |= {"x": ["y"], "y": ["x"], "z": ["x"], "u": ["u"], "v": ["u", "c0"]}
    got = link(spark, [("a", c, 1, "rate", '{"value":1}', ds) for c, ds in needs.items()])
    want = plain_levels(needs)
    assert {c: got["a", c].level for c in needs} == {c: want.get(c) for c in needs}
    order = sorted(want, key=lambda c: (want[c], c))
    assert [got["a", c].position for c in order] == list(range(len(order))) and got["a", "x"].position is None
    assert got["a", "z"].errors == "cycle" and not got["a", "z"].valid and got["a", "c69"].valid


def test_links_validates_and_writes_canonical_json(spark):
    calls = [
        ("a", "1", 0, "search", '{"limit": 3, "query":"x y", "exact" : false}', []),
        ("a", "2", 1, "search", '{"limit": "3"}', ["1", None, "gone"]),
        ("a", "3", 2, "search", '{"query": "q", "limit": 1, "b": 1, "a": null}', ["1"]),
        ("a", "4", 3, "lookup", "[1]", None), ("a", "5", 4, "nothing", "{}", []), ("a", "6", 5, "rate", '{"value": 1.5e0', []),
        ("a", "7", 6, "rate", '{"value": 1.50}', []), (None, "1", 0, "rate", '{"value": 2}', []), ("b", None, 0, "rate", "{}", []),
        ("a", "1", 9, "rate", "later, so not taken", []),
    ]
    results = [("a", "1", 5, "later"), ("a", "1", 4, "first"), ("a", "9", 4, "nobody asked"), ("b", "1", 1, "other conversation"), ("a", None, 1, "no id")]
    got = link(spark, calls, results)
    assert {k: r.errors for k, r in got.items()} == {
        ("a", "1"): "", ("a", "2"): "missing query; type of limit; unknown dependency", ("a", "3"): "unknown a b", ("a", "4"): "not an object",
        ("a", "5"): "unknown tool", ("a", "6"): "not an object", ("a", "7"): "", ("", "1"): "", ("a", "9"): "orphan result", ("b", "1"): "orphan result",
    }
    first = got["a", "1"]
    assert first.record == '{"arguments":{"exact":false,"limit":3,"query":"x y"},"id":"1","name":"search","result":{"content":"first","turn":4},"turn":0}'
    assert first.result_turn == 4 and got["a", "2"].level == 1 and json.loads(got["a", "7"].record)["arguments"] == {"value": 1.5}
    assert json.loads(got["a", "6"].record)["arguments_text"] == '{"value": 1.5e0' and "arguments" not in json.loads(got["a", "6"].record)
    assert {c: got["a", c].position for c in "1234567"} == {"1": 0, "4": 1, "5": 2, "6": 3, "7": 4, "2": 6, "3": 7} and got["a", "9"].position is None
    assert got["a", "9"].record is None and got["a", "9"].result_turn == 4


def test_hot_identifier_and_empty_tables(spark):
    got = link(spark, [("a", "1", k, "rate", '{"value":1}', []) for k in range(500)], [("a", "1", k, f"r{k}") for k in range(500)])
    assert len(got) == 1 and json.loads(got["a", "1"].record)["result"] == {"content": "r0", "turn": 0}
    assert link(spark, []) == {}


def test_every_row_of_a_repeated_identifier_is_returned(spark):
    calls = [("a", "1", k, "rate", '{"value":1}', []) for k in range(50)] + [
        ("a", "2", 1, "rate", '{"value":1}', ["1"]), ("a", "2", 2, "rate", "[]", ["2", "gone"]), ("a", "2", 2, "rate", "[]", ["2", "gone"]),
        ("a", "3", 1, "rate", '{"value":1}', ["3"]), ("a", "3", 2, "rate", '{"value":1}', ["3"]),
    ]
    results = [("a", "1", k, "r") for k in range(40)] + [("a", "9", 1, "r"), ("a", "9", 2, "r")]
    rows = t.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), t.SCHEMAS).collect()
    ones = [r for r in rows if r.call_id == "1"]
    assert sorted(r.turn for r in ones if r.name) == list(range(50)) and sorted(r.result_turn for r in ones if not r.name) == list(range(1, 40))
    assert {(r.turn == 0, r.errors, r.valid, r.result_turn) for r in ones if r.name} == {(True, "", True, 0), (False, "duplicate id", False, None)}
    assert {r.errors for r in ones if not r.name} == {"duplicate result"}
    seen = sorted((r.call_id, r.turn or 0, r.level, r.errors) for r in rows if r.call_id == "2")
    assert seen == [("2", 1, 1, "")] + [("2", 2, 2, "not an object; unknown dependency; duplicate id")] * 2
    assert sorted(r.errors for r in rows if r.call_id == "3") == ["cycle", "cycle; duplicate id"]
    assert sorted((r.errors, r.result_turn) for r in rows if r.call_id == "9") == [("orphan result", 1), ("orphan result", 2)]


def test_query_keeps_repeated_turns_and_null_conversations(spark, tmp_path):
    rows = [(1, 1, "assistant", "one two three")] * 3 + [(1, 2, "user", "a")] * 2 + [(None, 1, "assistant", "one"), (None, 2, "user", "b"), (2, None, "assistant", "one")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = t.op8_tool_calls(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id or 0, r.turn or 0, r.result_turn or 0, r.errors.split("; ")[-1]) for r in got) == [
        (0, 1, 2, ""), (1, 0, 2, "duplicate result"), (1, 1, 0, "duplicate id"), (1, 1, 0, "duplicate id"), (1, 1, 2, ""), (2, 0, 0, ""),
    ]


def test_very_long_arguments_and_clashing_columns(spark):
    text = "é " * 1_000_000
    calls = [("a", "1", 0, "search", json.dumps({"query": text, "limit": 1}, ensure_ascii=False), []), ("a", "2", 1, "search", '{"query": "' + text, ["1"])]
    extra = ["1 AS level", "2 AS position", "'x' AS errors", "3 AS row", "4 AS is_call", "5 AS needs", "6 AS content_", "7 AS record"]
    c = spark.createDataFrame(calls, CALLS).selectExpr("*", *extra).repartition(2)
    r = spark.createDataFrame([("a", "1", 3, text)], RESULTS).selectExpr("*", *extra)
    got = {x.call_id: x for x in t.link(c, r, t.SCHEMAS).collect()}
    first = json.loads(got["1"].record)
    assert first["arguments"] == {"query": text, "limit": 1} and first["result"] == {"content": text, "turn": 3} and got["1"].errors == ""
    assert got["2"].errors == "not an object" and json.loads(got["2"].record)["arguments_text"] == '{"query": "' + text
    assert (got["1"].level, got["2"].level, got["1"].position, got["2"].position) == (0, 1, 0, 1)
