"""Tool calls: order, schemas, odd rows; the registered query against its SQL twin is in test_queries."""

import json

import pytest

from corpusflow.llm import toolcalls

SCHEMA = '{"type":"object","required":["q"],"properties":{"q":{"type":"string"},"n":{"type":"integer","minimum":1}},"additionalProperties":false}'


def test_errors():
    schema = json.loads(SCHEMA)
    assert toolcalls.errors_of({"q": "x", "n": 2}, schema) == []
    assert toolcalls.errors_of({"q": {"$ref": "a"}}, schema) == []
    assert toolcalls.errors_of({"n": 0, "z": 1}, schema) == ["$.q: missing", "$.n: below minimum", "$.z: not allowed"]
    assert toolcalls.errors_of({"q": 1, "n": True}, schema) == ["$.n: not integer", "$.q: not string"]
    assert toolcalls.errors_of([1, "a"], {"type": "array", "items": {"type": ["integer", "null"]}}) == ["$[1]: not integer or null"]
    assert toolcalls.errors_of(2.0, {"type": "integer"}) == [] and toolcalls.errors_of(2.5, {"type": "integer"}) == ["$: not integer"]


def test_canonical():
    assert toolcalls.canonical(json.loads('{ "b": [1.50, "é\\u00e9\\n"], "a": {"d": null, "c": true}}')) == '{"a":{"c":true,"d":null},"b":[1.5,"éé\\n"]}'


CALLS = [
    (1, "a", 0, "f", '{"q":"x"}'), (1, "b", 1, "f", '{"q":{"$ref":"d"}}'), (1, "c", 2, "f", '{"q":{"$ref": "b"}}'), (1, "d", 3, "f", '{"q":{"$ref":"e"}}'),
    (1, "e", 3, "f", '{"q":"y"}'), (1, "g", 9, "f", '{"q":{"$ref":"a"}}'),
    (2, "a", 0, "f", '{"q":{"$ref":"b"}}'), (2, "b", 0, "f", '{"q":{"$ref":"a"}}'), (2, "c", 1, "f", '{"q":{"$ref":"b"}}'), (2, "d", 5, "f", '{"q":"z"}'),
    (3, "a", 4, "f", '{"q":"later"}'), (3, "a", 2, "f", '{"q":"sooner"}'), (3, "s", 1, "f", '{"q":{"$ref":"s"}}'), (3, "m", 1, "f", '{"q":{"$ref":"none"}}'),
    (3, "j", None, "f", "{not json"), (3, "n", 1, None, None), (3, "v", 1, "f", '{"q": NaN}'), (None, "a", 1, "f", "{}"), (3, None, 1, "f", "{}"),
    (4, "x", 1, "h", '{"q":"x"}'), (4, "x", 1, "h", '{"q":"x"}'),
]
RESULTS = [(1, "a", 1, "A"), (1, "a", 0, "first"), (3, "zz", 1, None), (None, "a", 1, "N"), (3, "j", 1, 'say "é"\n')]


@pytest.fixture(scope="module")
def rows(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, call_id string, seq long, name string, arguments string").selectExpr("*", "1 AS ready", "'x' AS content")
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, seq long, content string").selectExpr("*", "1 AS name")
    schemas = spark.createDataFrame([("f", SCHEMA), ("f", SCHEMA), (None, "{}")], "name string, schema string")
    found = toolcalls.link(calls, results, schemas).collect()
    assert toolcalls.link(calls.where("false"), results.where("false"), schemas).count() == 0
    return {(r.conv_id, r.call_id): r for r in found}


def test_order(rows):
    for key, r in rows.items():
        if r.status != "no_call" and not r.cyclic:
            for c in CALLS:
                if (c[0], c[1]) == key and c[4] and '"$ref"' in c[4]:
                    ref = rows.get((key[0], json.loads(c[4])["q"]["$ref"]))
                    if ref and ref is not r and not ref.cyclic:
                        assert (ref.ready, ref.depth, ref.seq) < (r.ready, r.depth, r.seq)
    assert (rows[1, "c"].ready, rows[1, "c"].depth) == (3, 3) and (rows[1, "g"].ready, rows[1, "g"].depth) == (9, 0)
    assert {k for k, r in rows.items() if r.cyclic} >= {(2, "a"), (2, "b")} and not rows[2, "d"].cyclic


def test_status_and_errors(rows):
    assert len(rows) == 18
    assert rows[1, "a"].status == "linked" and rows[1, "a"].n_results == 2 and json.loads(rows[1, "a"].canonical)["result"] == "first"
    assert rows[3, "zz"].status == "no_call" and not rows[3, "zz"].valid and rows[3, "zz"].canonical == '{"arguments":null,"id":"zz","name":null,"result":null}'
    assert json.loads(rows[3, "a"].canonical)["arguments"] == {"q": "sooner"} and rows[3, "a"].n_calls == 2
    assert rows[3, "s"].errors == "$ref s: of itself" and rows[3, "m"].errors == "$ref none: missing"
    assert rows[3, "j"].errors == rows[3, "n"].errors == rows[3, "v"].errors == "$: not JSON" and rows[3, "j"].seq == -1
    assert rows[4, "x"].errors == "$: unknown tool" and rows[4, "x"].n_calls == 2
    assert "circle" in rows[2, "a"].errors and rows[2, "d"].valid and rows[1, "c"].valid
    for r in rows.values():
        assert toolcalls.canonical(json.loads(r.canonical)) == r.canonical


@pytest.mark.parametrize("arguments,schema,errors,line", [
    ('{"x":1e999}', "{}", ["$: not JSON"], None),
    ('{"x":"\\ud800"}', "{}", ["$: not JSON"], None),
    ("[" * 100_000, "{}", ["$: not JSON"], None),
    ("1" * 5000, "{}", ["$: not JSON"], None),
    ('{"a":1,"a":2}', "{}", ["$: repeated key a"], '{"a":2}'),
    ('{"x":1}', '{"type":"foo"}', ["schema: unknown type foo"], '{"x":1}'),
    ('{"x":1}', '{"type":["object","foo"]}', ["schema: unknown type foo"], '{"x":1}'),
    ('{"x":1}', "no json", ["schema: not JSON"], '{"x":1}'),
    ('{"x":1}', "[]", ["schema: no object"], '{"x":1}'),
    ('{"x":1}', "true", [], '{"x":1}'),
    ('{"x":1}', "false", ["$: not allowed"], '{"x":1}'),
    ('{"x":1}', '{"properties":{"x":false}}', ["$.x: not allowed"], '{"x":1}'),
    ('{"x":1}', '{"$ref":"#/d"}', ["schema: unknown word $ref"], '{"x":1}'),
    ('{"x":1}', '{"minimum":"a","properties":[]}', [], '{"x":1}'),
    ('2', '{"minimum":"a"}', ["schema: not usable"], "2"),
    ('"a"', '{"pattern":"("}', ["schema: not usable"], '"a"'),
    ('"a"', '{"minLength":3,"pattern":"^b"}', ["$: too short", "$: no match of pattern"], '"a"'),
    ("true", '{"enum":[1]}', ["$: not in enum"], "true"),
    ("1.0", '{"enum":[1],"const":1}', [], "1.0"),
    ('[1,"a"]', '{"maxItems":1,"items":{"anyOf":[{"type":"integer"},{"type":"null"}]}}', ["$: too many items", "$[1]: fits none of anyOf"], '[1,"a"]'),
    ("3", '{"allOf":[{"exclusiveMaximum":3},{"type":"integer"}],"title":"t"}', ["$: above maximum"], "3"),
])
def test_no_row_ends_a_job(arguments, schema, errors, line):
    assert toolcalls._checked("f", arguments, schema) == (errors, line)


def test_hash_join_and_long_forward_chain(spark):
    n = 12
    chain = [(1, f"c{i}", i, "f", f'{{"q":{{"$ref":"c{i + 1}"}}}}' if i < n else '{"q":"x"}') for i in range(n + 1)]
    calls = spark.createDataFrame(chain + [(2, "a", 0, "f", '{"q":"x"}')], "conv_id long, call_id string, seq long, name string, arguments string")
    order = toolcalls.topological(calls.selectExpr("conv_id", "call_id", "seq", "regexp_extract_all(arguments, 'ref\":\"(c[0-9]+)', 1) AS refs"))
    found = {(r.conv_id, r.call_id): (r.ready, r.depth) for r in order.collect()}
    assert len(found) == n + 2 and found[2, "a"] == (0, 0) and [found[1, f"c{i}"] for i in range(n, -1, -1)] == [(n, i) for i in range(n + 1)]
