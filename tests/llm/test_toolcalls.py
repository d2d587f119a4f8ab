"""Operator 3: hand-made calls, deep chains and cycles; the SQL comparison is in tests/test_oracle.py."""

import json

from etholith.llm.common import QUERIES
from etholith.llm.toolcalls import link_calls, tool_messages

SCHEMAS = {
    "add": {"properties": {"a": {"type": "integer"}, "b": {"type": "number"}, "how": {"type": "string", "enum": ["fast", "slow"]}}, "required": ["a"]},
    "free": {"properties": {"x": {"type": "array"}, "o": {"type": "object"}, "t": {"type": "boolean"}}, "required": [], "additionalProperties": True},
}
CALLS = [
    (1, 0, "c0", "add", '{"b": 2.50, "a": 1}', None),
    (1, 1, "c1", "add", '{"a": "x", "zz": 1, "how": "no"}', "c0"),
    (1, 2, "c2", "free", '{"x": [1, {"d": null, "c": "é\\n"}], "q": 1, "t": true, "o": {}}', "c1"),
    (1, 3, "c3", "add", "not json", "gone"),
    (1, 4, "c4", "nope", "{}", "c2"),
    (1, 5, "c5", "add", None, "c6"),
    (1, 6, "c6", "add", "[1]", "c5"),
    (1, 7, "c7", "add", "{}", "c5"),
    (1, 9, "c0", "add", '{"a": 9}', None),
    (2, 0, "c0", "add", '{"a": 3}', None),
    (None, 0, "n", "add", '{"a": 3}', None),
    (2, 1, None, "add", '{"a": 3}', None),
]
RESULTS = [(1, 3, "c0", "three"), (1, 1, "c2", "too soon"), (1, 8, "lost", None), (None, 1, "n", "found"), (1, 4, "c0", "again"), (3, 1, "c0", "other conversation")]


def frames(spark, calls=CALLS, results=RESULTS):
    return (
        spark.createDataFrame([(*c, "x") for c in calls], "conv_id long, turn long, call_id string, name string, arguments string, after string, level string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
    )


def test_cases(spark):
    rows = {(r.conv_id, r.call_id): r for r in link_calls(*frames(spark), SCHEMAS).collect()}
    assert len(rows) == 12
    got = {k: (r.status, r.level, r.valid, r.errors) for k, r in rows.items()}
    assert got[1, "c0"] == ("linked", 0, True, [])
    assert got[1, "c1"] == ("unanswered", 1, False, ["type a", "unexpected zz", "value how"])
    assert got[1, "c2"] == ("early", 2, True, [])
    assert got[1, "c3"] == ("unanswered", 0, False, ["invalid json"])
    assert got[1, "c4"] == ("unanswered", 3, False, ["unknown tool"])
    assert got[1, "c5"] == ("unanswered", None, False, ["invalid json"])
    assert got[1, "c6"] == ("unanswered", None, False, ["not an object"])
    assert got[1, "c7"] == ("unanswered", None, False, ["missing a"])
    assert got[1, "lost"] == ("orphan", None, False, []) and got[3, "c0"][0] == "orphan"
    assert got[2, "c0"] == ("unanswered", 0, True, []) and got[None, "n"] == ("linked", 0, True, [])
    assert rows[1, "c0"].record == (
        '{"arguments":{"a":1,"b":2.5},"call_id":"c0","conv_id":1,"errors":[],"level":0,"name":"add","result":"three","status":"linked","turn":0}'
    )
    assert '{"arguments":{"o":{},"q":1,"t":true,"x":[1,{"c":"é\\n","d":null}]},' in rows[1, "c2"].record
    order = sorted((r for k, r in rows.items() if k[0] == 1), key=lambda r: r.position)
    assert [r.position for r in order] == list(range(9))
    assert [r.call_id for r in order] == ["c0", "c3", "c1", "c2", "c4", "c5", "c6", "c7", "lost"]
    for r in rows.values():
        assert json.dumps(json.loads(r.record), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.record


NESTED = {
    "deep": {
        "properties": {
            "a": {"type": "object", "properties": {"b": {"type": "integer", "minimum": 2, "maximum": 5}, "c": {"type": ["string", "null"], "maxLength": 3}}, "required": ["b"]},
            "list": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "number", "exclusiveMinimum": 0}}, "additionalProperties": True}},
            "any": {},
            "pick": {"enum": [1, "two", None, True, {"x": [1]}]},
            "it's": {"type": "boolean"},
            'say "so"': {"minLength": 2},
            "it's \"both\"": {"type": "integer"},
        },
        "required": ["it's"],
    }
}


def test_nested_schemas(spark):
    good = {"a": {"b": 3, "c": None}, "list": [{"n": 1}, {"n": 0.5, "more": 1}], "any": [1], "pick": 1.0, "it's": True, 'say "so"': "ok", "it's \"both\"": 2}
    cases = [
        (good, []),
        ({"it's": False}, []),
        ({}, ["missing it's"]),
        ({**good, "a": {"b": "no", "c": "long", "d": 1}}, ["long a.c", "type a.b", "unexpected a.d"]),
        ({**good, "a": {"c": 1}}, ["missing a.b", "type a.c"]),
        ({**good, "a": {"b": 1}}, ["small a.b"]),
        ({**good, "a": {"b": 6}}, ["large a.b"]),
        ({**good, "a": [1], "any": None}, ["type a"]),
        ({**good, "list": [{"n": 0}, {"n": "x"}, 3, {"n": -1}]}, ["small list[].n", "type list[]", "type list[].n"]),
        ({**good, "list": {}}, ["type list"]),
        *[({**good, "pick": v}, []) for v in ("two", None, True, {"x": [1]})],
        *[({**good, "pick": v}, ["value pick"]) for v in (2, "three", False, {"x": [2]}, [])],
        ({**good, "it's": 1, 'say "so"': "o", "it's \"both\"": "x"}, ["short say \"so\"", "type it's", "type it's \"both\""]),
    ]
    calls = [(1, k, f"c{k}", "deep", json.dumps(arguments), None) for k, (arguments, _) in enumerate(cases)]
    rows = {r.call_id: r.errors for r in link_calls(*frames(spark, calls, [(1, 1, "c0", "r")]), NESTED).collect()}
    for k, (arguments, want) in enumerate(cases):
        assert rows[f"c{k}"] == want, arguments


def test_long_chain(spark):
    n = 3000
    calls = [(7, k, f"k{k}", "add", '{"a": 1}', f"k{k - 1}" if k else None) for k in range(n)]
    rows = link_calls(*frames(spark, calls, RESULTS[:0] or [(7, 1, "k0", "r")]), SCHEMAS).select("call_id", "level", "position").collect()
    assert all(r.level == r.position == int(r.call_id[1:]) for r in rows) and len(rows) == n


def test_messages(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "add", "arguments": "{\\"a\\": 2}"}, {"id": "b", "name": "add", "arguments": "{}", "after": "a"}]}'),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "2"}'), (1, 3, "assistant", "plain"), (1, 4, None, None), (1, 5, "tool", "broken"),
    ]
    calls, results = tool_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: (r.status, r.level, r.valid) for r in link_calls(calls, results, SCHEMAS).collect()}
    assert got == {"a": ("linked", 0, True), "b": ("unanswered", 1, False)}


def test_empty(spark):
    calls, results = frames(spark)
    assert link_calls(calls.limit(0), results.limit(0), SCHEMAS).count() == 0
    assert link_calls(calls.limit(0), results, SCHEMAS).filter("status = 'orphan'").count() == 5
    assert "op3_tool_calls" in QUERIES
